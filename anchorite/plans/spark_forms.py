"""Spark's own forms of tables and queries; the oracle keeps the texts that define them.

The places of tokens, named spans and candidates are read off each document's own
row: neighbours come from its array of words, what is known of a surface comes from
tables of surfaces (as many rows as there are titles), which are broadcast. So no
token is shuffled, sorted or joined to another one by its place. Both forms give the
same rows where doc_id is a key of documents and page_id one of pages.
"""

from __future__ import annotations

from .tables_link import SCORE, cap

RATE = "round(CAST({0} AS DOUBLE) / nullif({1}, 0), 6)"
NUMBER = "CAST(CAST({} AS DECIMAL(18, 6)) AS VARCHAR(40))"


def surface(x: str) -> str:
    return f"lower(replace(replace({x}, '.', ''), ',', ''))"


def stops(x: str) -> str:
    return f"({x} LIKE '%.' OR {x} LIKE '%!' OR {x} LIKE '%?')"


#: Characters that a word takes with the space behind it; only a text's first and last pieces may be empty.
WIDTH = "IF(x = '', 0L, length(x) + 1L)"
OF_GOLD = "(SELECT DISTINCT title FROM anchors)"

TABLES = {
    # Generators are outer and arrays never null: else Catalyst infers filters that compute whole arrays once more, for each word of them.
    "tokens": "SELECT doc_id, CAST(pos AS BIGINT) AS pos, tok FROM (SELECT doc_id, posexplode_outer(split(text, '[ \n]+')) AS (pos, tok) FROM documents) WHERE tok <> ''",
    # Offsets are summed within stretches of 64 words, over sums of stretches, so that no long array is copied word by word.
    "doc_words": f"""SELECT doc_id, toks, coalesce(flatten(zip_with(chunks, slice(aggregate(chunks, array(0L), (a, c) -> array_append(a, element_at(a, -1) + aggregate(c, 0L, (s, x) -> s + {WIDTH}))), 1, size(chunks)),
        (c, b) -> slice(aggregate(c, array(b), (a, x) -> array_append(a, element_at(a, -1) + {WIDTH})), 1, size(c)))), array()) AS offs
        FROM (SELECT doc_id, toks, coalesce(transform(sequence(0, (size(toks) - 1) DIV 64), j -> slice(toks, j * 64 + 1, 64)), array()) AS chunks FROM (SELECT doc_id, coalesce(split(text, '[ \n]+'), array('')) AS toks FROM documents WHERE text IS NOT NULL))""",
    "placed": f"""SELECT doc_id, pos, tok, {surface("tok")} AS surface, cs, CAST(length(tok) AS BIGINT) AS cl, {cap("tok")} AS cap, coalesce({cap("before")}, FALSE) AS cap_before, before, before2, after,
        before IS NULL OR {stops("before")} AS starts, {stops("tok")} AS ends FROM (SELECT doc_id, CAST(i AS BIGINT) AS pos, tok, get(offs, i) AS cs, nullif(get(toks, i - 1), '') AS before, nullif(get(toks, i - 2), '') AS before2,
        nullif(get(toks, i + 1), '') AS after FROM (SELECT doc_id, toks, offs, posexplode_outer(toks) AS (i, tok) FROM doc_words) WHERE tok <> '')""",
    # A span begins at a capitalised word that no capitalised word precedes in its sentence and ends where none follows.
    "spans": f"""SELECT doc_id, toks, offs, s, get(ends, k) + 1 AS e FROM (SELECT doc_id, toks, offs, ends, posexplode_outer(begins) AS (k, s) FROM (SELECT doc_id, toks, offs,
        coalesce(filter(caps, (i, k) -> NOT (coalesce(get(caps, k - 1) = i - 1, FALSE) AND NOT {stops("get(toks, i - 1)")})), array()) AS begins, coalesce(filter(caps, (i, k) -> NOT (coalesce(get(caps, k + 1) = i + 1, FALSE) AND NOT {stops("get(toks, i)")})), array()) AS ends
        FROM (SELECT doc_id, toks, offs, coalesce(filter(sequence(0, size(toks) - 1), i -> {cap("get(toks, i)")}), array()) AS caps FROM doc_words))) WHERE s IS NOT NULL""",
    "named_beside": """SELECT doc_id, s, e, cs, ce, name, head, last, lower(name) AS low, CASE WHEN k < '4' THEN 'PER' WHEN k < '8' THEN 'LOC' WHEN k < 'c' THEN 'ORG' ELSE 'MISC' END AS label, head_surface, before, after
        FROM (SELECT *, substr(md5(lower(head_surface)), 1, 1) AS k FROM (SELECT doc_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, get(offs, s) AS cs, get(offs, e - 1) + length(get(toks, e - 1)) AS ce,
        array_join(slice(toks, s + 1, e - s), ' ') AS name, get(toks, s) AS head, get(toks, e - 1) AS last, """
    + surface("get(toks, s)")
    + """ AS head_surface, nullif(get(toks, s - 1), '') AS before, nullif(get(toks, e), '') AS after FROM spans))""",
    "named": "SELECT doc_id, s, e, cs, ce, name, head, last, low, label FROM named_beside",
    "mentions": "SELECT /*+ BROADCAST(f) */ t.doc_id, t.pos, t.tok, t.surface, f.linkability, f.ambiguity, f.singletons, f.linked_count, f.total_count FROM token_surfaces t JOIN surface_forms f ON t.surface = f.surface",
    "seen_counts": "SELECT /*+ BROADCAST(l) */ t.surface, count(*) AS seen FROM token_surfaces t LEFT SEMI JOIN linked_counts l ON l.surface = t.surface GROUP BY t.surface",
    "mention_places": "SELECT /*+ BROADCAST(l) */ p.doc_id, p.pos, p.cs, p.cl, p.surface FROM placed p JOIN linked_counts l ON l.surface = p.surface",
    "gold": f"SELECT /*+ BROADCAST(t) */ m.doc_id, m.pos, t.title AS gold FROM mentions m LEFT JOIN {OF_GOLD} t ON m.tok = t.title",
    "candidates": "SELECT /*+ BROADCAST(c) */ m.doc_id, m.pos, m.surface, m.linkability, c.title, c.p_title, c.p_surface, c.n, c.rank FROM mentions m JOIN surface_candidates c ON m.surface = c.surface WHERE c.rank <= 20",
    "best": "SELECT /*+ BROADCAST(c) */ m.doc_id, m.pos, m.tok, m.surface, m.linkability, c.title AS top, c.p_title FROM mentions m JOIN surface_candidates c ON m.surface = c.surface WHERE c.rank = 1",
    # What is decided of a mention and its gold title, in one row.
    "judged": f"SELECT /*+ BROADCAST(t) */ b.doc_id, b.pos, b.tok, b.surface, b.linkability, b.top, b.p_title, CASE WHEN b.linkability >= 0.05 AND length(b.surface) >= 2 THEN b.top END AS link, t.title AS gold FROM best b LEFT JOIN {OF_GOLD} t ON t.title = b.tok WHERE b.doc_id IS NOT NULL",
    # The score of a candidate depends on its surface only: candidates are ranked once a surface.
    "surface_scored": f"SELECT surface, title, rank, p_title, p_surface, {SCORE} AS score FROM surface_candidates WHERE rank <= 20",
    "surface_ranked": "SELECT surface, title, rank, p_title, p_surface, score, CAST(row_number() OVER w AS BIGINT) AS place, lead(title) OVER w AS second, lead(score) OVER w AS score2, lead(p_title) OVER w AS p_title2, lead(p_surface) OVER w AS p_surface2, lead(rank) OVER w AS rank2 FROM surface_scored WINDOW w AS (PARTITION BY surface ORDER BY score DESC, rank)",
    "ranked": "SELECT /*+ BROADCAST(c) */ m.doc_id, m.pos, m.surface, c.title, c.rank, c.p_title, c.p_surface, m.linkability, c.score, c.place, c.second, c.score2, c.p_title2, c.p_surface2, c.rank2 FROM mentions m JOIN surface_ranked c ON c.surface = m.surface",
    "names": "SELECT /*+ BROADCAST(b) */ n.doc_id, n.s, n.e, n.cs, n.name, n.low, n.label, n.head, n.last, b.title AS top, b.score FROM named_beside n LEFT JOIN (SELECT surface, title, score FROM surface_ranked WHERE place = 1) b ON b.surface = n.head_surface",
    # Surfaces of a document in order, so that equal ones lie together; a word of the text gives one surface.
    "doc_terms": f"SELECT doc_id, source, words, coalesce(filter(sequence(0, size(words) - 1), i -> i = 0 OR words[i] <> words[i - 1]), array()) AS firsts FROM (SELECT doc_id, source, coalesce(sort_array(split(trim(regexp_replace({surface('text')}, '[ \n]+', ' ')), ' ')), array('')) AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)",
    "doc_tf": "SELECT doc_id, source, words[i] AS token, CAST(coalesce(get(firsts, k + 1), size(words)) - i AS BIGINT) AS tf FROM (SELECT doc_id, source, words, firsts, posexplode_outer(firsts) AS (k, i) FROM doc_terms) WHERE words[i] <> ''",
    "doc_bags": f"SELECT doc_id, coalesce(split(trim(regexp_replace({surface('text')}, '[ \n]+', ' ')), ' '), array('')) AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL",
    "term_counts": "SELECT doc_id, token, tf FROM doc_tf",
    "source_terms": "SELECT source AS title, token, sum(tf) AS tf, count(*) AS d FROM doc_tf GROUP BY source, token",
    "source_counts": "SELECT title, token, tf FROM source_terms",
    "surface_best": "SELECT f.surface, f.linkability, c.title AS top, CASE WHEN f.linkability >= 0.05 AND length(f.surface) >= 2 THEN c.title END AS link FROM surface_forms f JOIN surface_candidates c ON c.surface = f.surface AND c.rank = 1",
}

#: The graph of links. Each triangle is found once, from its vertex of least degree, so that a hub's links are not joined with one another;
#: its three pairs give what two linked pages share, both ways.
GRAPH = {
    "degrees": "SELECT id, count_if(o) AS n_out, count_if(NOT o) AS n_in FROM (SELECT src AS id, TRUE AS o FROM links UNION ALL SELECT dst, FALSE FROM links) x GROUP BY id",
    "titles_n": "SELECT count(*) AS n FROM degrees",
    "linked_pairs": "SELECT a, b, max(f) AS fwd, max(NOT f) AS bwd FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, src < dst AS f FROM links) x GROUP BY a, b",
    "sized_pairs": "SELECT p.a, p.b, p.fwd, p.bwd, x.n_in AS in_a, x.n_out AS out_a, y.n_in AS in_b, y.n_out AS out_b FROM linked_pairs p JOIN degrees x ON x.id = p.a JOIN degrees y ON y.id = p.b",
    "oriented": "SELECT CASE WHEN low THEN a ELSE b END AS u, CASE WHEN low THEN b ELSE a END AS v FROM (SELECT a, b, in_a + out_a < in_b + out_b OR (in_a + out_a = in_b + out_b AND a < b) AS low FROM sized_pairs) x",
    "adjacent": "SELECT u, collect_list(v) AS vs FROM oriented GROUP BY u",
    "triangles": "SELECT t[0] AS p, t[1] AS q, t[2] AS r FROM (SELECT sort_array(array(u, v, w)) AS t FROM (SELECT x.u, x.v, explode_outer(array_intersect(x.vs, y.vs)) AS w FROM (SELECT u, vs, explode_outer(vs) AS v FROM adjacent) x JOIN adjacent y ON y.u = x.v) z WHERE w IS NOT NULL) t",
    "triads": """SELECT inline(array(struct(p AS a, q AS b, r AS third, pr_b AND qr_b AS i, pr_f AND qr_f AS o), struct(p AS a, r AS b, q AS third, pq_b AND qr_f AS i, pq_f AND qr_b AS o), struct(q AS a, r AS b, p AS third, pq_f AND pr_f AS i, pq_b AND pr_b AS o)))
        FROM (SELECT t.p, t.q, t.r, e.fwd AS pq_f, e.bwd AS pq_b, f.fwd AS pr_f, f.bwd AS pr_b, g.fwd AS qr_f, g.bwd AS qr_b FROM triangles t JOIN linked_pairs e ON e.a = t.p AND e.b = t.q JOIN linked_pairs f ON f.a = t.p AND f.b = t.r JOIN linked_pairs g ON g.a = t.q AND g.b = t.r) x""",
    "pair_shared": "SELECT a, b, nullif(count_if(i), 0) AS i, nullif(count_if(o), 0) AS o FROM triads GROUP BY a, b",
    "in_shared": "SELECT a, b, i FROM pair_shared WHERE i IS NOT NULL",
    "out_shared": "SELECT a, b, o AS i FROM pair_shared WHERE o IS NOT NULL",
    "pairwise_sim": """SELECT p.a, p.b, coalesce(1000.0 * s.i / (CAST(p.in_a AS DOUBLE) * p.in_b), 0) AS in_pmi, coalesce(1000.0 * s.o / (CAST(p.out_a AS DOUBLE) * p.out_b), 0) AS out_pmi,
        coalesce(1 - (ln(greatest(p.in_a, p.in_b)) - ln(s.i)) / (ln(t.n) - ln(least(p.in_a, p.in_b))), 0) AS in_ngd, coalesce(1 - (ln(greatest(p.out_a, p.out_b)) - ln(s.o)) / (ln(t.n) - ln(least(p.out_a, p.out_b))), 0) AS out_ngd, p.fwd AND p.bwd AS two_way
        FROM (SELECT a, b, fwd, bwd, nullif(in_a, 0) AS in_a, nullif(out_a, 0) AS out_a, nullif(in_b, 0) AS in_b, nullif(out_b, 0) AS out_b FROM sized_pairs) p CROSS JOIN titles_n t LEFT JOIN pair_shared s ON s.a = p.a AND s.b = p.b""",
    "specificity": "SELECT id, CASE WHEN n_in > 0 THEN CAST(1 AS DOUBLE) / n_in ELSE 0.01 END AS w FROM degrees",
    "pair_dots": "SELECT x.a, x.b, sum(CASE WHEN x.i THEN s.w * s.w END) AS in_dot, sum(CASE WHEN x.o THEN s.w * s.w END) AS out_dot FROM triads x JOIN specificity s ON s.id = x.third GROUP BY x.a, x.b",
    "in_dots": "SELECT a, b, in_dot AS dot FROM pair_dots WHERE in_dot IS NOT NULL",
    "out_dots": "SELECT a, b, out_dot AS dot FROM pair_dots WHERE out_dot IS NOT NULL",
    "norms": "SELECT id, sqrt(sum(i)) AS n_in, sqrt(sum(o)) AS n_out FROM (SELECT x.dst AS id, s.w * s.w AS i, CAST(NULL AS DOUBLE) AS o FROM links x JOIN specificity s ON s.id = x.src UNION ALL SELECT x.src, NULL, s.w * s.w FROM links x JOIN specificity s ON s.id = x.dst) y GROUP BY id",
}
TABLES |= GRAPH

#: Joins by the place of a mention, and the table that has both sides in a row.
SAME_ROW = {
    "decided x JOIN gold g ON g.doc_id = x.doc_id AND g.pos = x.pos": "(SELECT struct(doc_id, pos, tok, surface, top, p_title, link) AS x, struct(doc_id, pos, gold) AS g FROM judged)",
}

MISTAKE = "CASE WHEN gold IS NULL THEN 'spurious' WHEN link IS NULL THEN 'missed' ELSE 'wrong' END"
#: Counts of an outcome at each place of the ranking come from one pass over the mentions.
OUTCOMES = """SELECT k, CAST(sum(tp) OVER (ORDER BY k) AS BIGINT) AS tp, CAST(sum(fp) OVER (ORDER BY k) AS BIGINT) AS fp, CAST(sum(mismatch) OVER (ORDER BY k) AS BIGINT) AS mismatch, t.tn, t.fn
    FROM (SELECT ks.k, sum(coalesce(c.tp, 0)) AS tp, sum(coalesce(c.fp, 0)) AS fp, sum(coalesce(c.mismatch, 0)) AS mismatch FROM (SELECT CAST(r_regionkey AS BIGINT) + 1 AS k FROM region) ks
        LEFT JOIN (SELECT r.place, sum(CASE WHEN r.title = j.gold THEN j.n ELSE 0 END) AS tp, sum(CASE WHEN j.gold IS NULL THEN j.n ELSE 0 END) AS fp, sum(CASE WHEN j.gold <> r.title THEN j.n ELSE 0 END) AS mismatch
            FROM (SELECT surface, gold, count(*) AS n FROM judged WHERE link IS NOT NULL GROUP BY surface, gold) j JOIN surface_ranked r ON r.surface = j.surface WHERE r.place <= 5 GROUP BY r.place) c ON c.place = ks.k GROUP BY ks.k) h
    CROSS JOIN (SELECT CAST(sum(CASE WHEN gold IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN gold IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM judged WHERE link IS NULL) t"""

QUERIES: dict[str, str] = {
    "E1_outcomes_at_k": OUTCOMES,
    "E2_scores_at_k": f"SELECT k, {RATE.format('tp', 'tp + fp + mismatch')} AS precision_, {RATE.format('tp', 'tp + fn + mismatch')} AS recall_, {RATE.format('tp + tn', 'tp + fp + tn + fn + mismatch')} AS accuracy, round(2e0 * tp / nullif(2 * tp + fp + fn + 2 * mismatch, 0), 6) AS f1 FROM ({OUTCOMES}) o",
    # A title has one surface: what a document links and what it holds of gold are compared surface by surface.
    "E3_bag_of_concepts": """SELECT doc_id, count(link) AS predicted, CAST(sum(n_gold) AS BIGINT) AS expected, CAST(sum(hit) AS BIGINT) AS correct, CAST(sum(CASE WHEN link IS NOT NULL AND hit = 0 AND n_gold > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wrong_on_all_text
        FROM (SELECT doc_id, surface, link, count(gold) AS n_gold, max(CASE WHEN gold = link THEN 1 ELSE 0 END) AS hit FROM (SELECT DISTINCT doc_id, surface, link, gold FROM judged) x GROUP BY doc_id, surface, link) y GROUP BY doc_id HAVING count(link) > 0""",
    "O9_training_lines": f"""SELECT /*+ BROADCAST(c, m) */ g.doc_id, g.pos, c.title, CASE WHEN c.title = g.gold THEN '1' ELSE '-1' END || ' 1:' || {NUMBER.format('c.p_title')} || ' 2:' || {NUMBER.format('c.p_surface')} || ' 3:' || {NUMBER.format('CAST(c.rank AS DOUBLE) / m.largest')} AS line
        FROM judged g JOIN surface_candidates c ON c.surface = g.surface AND c.rank <= 20 CROSS JOIN (SELECT max(x.rank) AS largest FROM surface_candidates x JOIN seen_counts s ON s.surface = x.surface WHERE x.rank <= 20) m""",
    # 50 characters lie within 26 words on either side.
    "O10_error_report": f"""SELECT /*+ BROADCAST(b, t) */ p.doc_id, p.pos, {MISTAKE.replace('gold', 't.title').replace('link', 'b.link')} AS mistake, b.link AS predicted, t.title AS gold, right(p.ahead, 50) || p.tok || left(p.behind, 50) AS context
        FROM (SELECT doc_id, CAST(i AS BIGINT) AS pos, tok, {surface('tok')} AS surface, CASE WHEN i > first THEN array_join(slice(toks, greatest(i - 26, first) + 1, least(26, i - first)), ' ') || ' ' ELSE '' END AS ahead, CASE WHEN i + 1 < size(toks) THEN ' ' || array_join(slice(toks, i + 2, 26), ' ') ELSE '' END AS behind
            FROM (SELECT doc_id, toks, CASE WHEN toks[0] = '' THEN 1 ELSE 0 END AS first, posexplode_outer(toks) AS (i, tok) FROM doc_words WHERE doc_id IS NOT NULL) x WHERE tok <> '') p
        JOIN surface_best b ON b.surface = p.surface LEFT JOIN (SELECT DISTINCT title FROM anchors) t ON t.title = p.tok WHERE coalesce(b.link, '*null*') <> coalesce(t.title, '*null*')""",
    "O10_mistake_counts": f"SELECT {MISTAKE} AS mistake, count(*) AS n FROM judged WHERE coalesce(link, '*null*') <> coalesce(gold, '*null*') GROUP BY 1",
    "M6_merged_spans": "SELECT doc_id, pos, coalesce(gold, surface) AS surface FROM judged WHERE linkability < 0.5 OR gold IS NOT NULL",
    "M8_long_names": f"SELECT /*+ BROADCAST(t) */ n.doc_id, n.s, n.e, n.name FROM named_beside n LEFT JOIN stops t ON t.token = lower(n.before) WHERE n.doc_id IS NOT NULL AND n.after IS NOT NULL AND n.e - n.s > 1 AND length(n.name) - length(replace(n.name, ',', '')) <= 1 AND NOT {stops('n.last')} AND NOT (coalesce({cap('n.before')}, FALSE) AND t.token IS NULL AND NOT (n.before IS NULL OR {stops('n.before')}))",
    "M10_eligible": "SELECT /*+ BROADCAST(c, r, t) */ p.doc_id, p.pos, c.surface IS NOT NULL AS has_candidates, r.title IS NOT NULL AS is_title FROM placed p LEFT JOIN linked_counts c ON c.surface = p.surface LEFT JOIN raw_titles r ON r.title = p.tok LEFT ANTI JOIN stops t ON t.token = p.surface WHERE c.surface IS NOT NULL OR r.title IS NOT NULL OR (p.cap AND NOT p.cap_before AND NOT p.starts)",
    "Q6_election": """SELECT doc_id, head, title AS elected FROM (SELECT doc_id, head, title, row_number() OVER (PARTITION BY doc_id, head ORDER BY votes DESC, title) AS k FROM (
        SELECT doc_id, head, coalesce(top, '*null*') AS title, round(sum(CASE WHEN e - s > 1 THEN coalesce(score, 1e0) ELSE 0e0 END) + CASE WHEN sum(CASE WHEN e - s > 1 AND top IS NOT NULL THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN e - s = 1 AND top IS NOT NULL THEN 1e0 ELSE 0e0 END) ELSE 0e0 END, 6) AS votes
        FROM (SELECT doc_id, s, e, CASE WHEN e - s > 1 THEN lower(head) ELSE low END AS head, top, score FROM names) n GROUP BY doc_id, head, coalesce(top, '*null*') HAVING sum(CASE WHEN e - s > 1 THEN 1 ELSE 0 END) > 0) v) x WHERE k = 1""",
    "Q7_heads": "SELECT doc_id, s AS child, h AS head, low FROM (SELECT doc_id, s, e, low, first_value(s) OVER (PARTITION BY doc_id, low ORDER BY -coalesce(score, 0e0), s) AS h FROM names WHERE doc_id IS NOT NULL) x WHERE s <> h AND e - s <= 2",
    "Q8_exceptions": """SELECT doc_id, low, element_at(array('PER', 'LOC', 'ORG', 'MISC'), least_label) AS label FROM (SELECT doc_id, low, min(l) AS least_label FROM (SELECT doc_id, low, e - s AS n, CASE label WHEN 'PER' THEN 1 WHEN 'LOC' THEN 2 WHEN 'ORG' THEN 3 ELSE 4 END AS l FROM named) y
        GROUP BY doc_id, low HAVING min(l) = max(l) AND max(n) <= 3) x""",
    "W1_ranker_samples": """SELECT /*+ BROADCAST(g, c) */ m.doc_id, m.pos, c.title, CASE WHEN m.flip THEN -1 ELSE 1 END AS label, round(CASE WHEN m.flip THEN c.p_title - g.p_title ELSE g.p_title - c.p_title END, 9) + 0e0 AS d_title, round(CASE WHEN m.flip THEN c.p_surface - g.p_surface ELSE g.p_surface - c.p_surface END, 9) + 0e0 AS d_surface
        FROM (SELECT doc_id, pos, surface, gold, substr(md5(CAST(doc_id AS VARCHAR(20)) || '_' || CAST(pos AS VARCHAR(20))), 1, 1) < '8' AS flip FROM judged WHERE gold IS NOT NULL) m JOIN surface_candidates g ON g.surface = m.surface AND g.title = m.gold AND g.rank <= 20 JOIN surface_candidates c ON c.surface = m.surface AND c.title <> g.title AND c.rank <= 20""",
    "A6_service_labels": "SELECT /*+ BROADCAST(x) */ p.doc_id, p.pos, p.tok, CASE WHEN x.top IS NULL THEN 'UNMAPPED' ELSE x.top END AS label, x.link IS NOT NULL AND x.linkability > 0.05 AS is_linked FROM placed p LEFT JOIN surface_best x ON x.surface = p.surface WHERE x.top IS NOT NULL OR (NOT p.cap AND length(p.tok) > 3)",
    # Few words of each source are looked for: they go to the documents, not the documents' words to them.
    "L11_bm25": """SELECT source, doc_id, score, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS BIGINT) AS k FROM (SELECT h.source, h.doc_id, round(sum(ln(1 + (d.n - h.df + 0.5) / (h.df + 0.5)) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * h.size / a.size))), 5) AS score
        FROM (SELECT /*+ BROADCAST(q) */ q.source, t.doc_id, t.size, q.token, q.df, count(*) AS tf FROM (SELECT doc_id, CAST(size(words) AS DOUBLE) AS size, explode_outer(words) AS token FROM doc_bags) t
            JOIN (SELECT title AS source, token, df FROM (SELECT title, token, df, row_number() OVER (PARTITION BY title ORDER BY tf DESC, token) AS r FROM (SELECT title, token, tf, sum(d) OVER (PARTITION BY token) AS df FROM source_terms) y WHERE length(token) > 5) x WHERE r <= 3) q ON q.token = t.token GROUP BY q.source, t.doc_id, t.size, q.token, q.df) h
        CROSS JOIN (SELECT CAST(sum(size(words)) AS DOUBLE) / count(*) AS size FROM doc_bags WHERE words[0] <> '') a CROSS JOIN n_docs d GROUP BY h.source, h.doc_id) s WHERE score > 2.0""",
    # A word's rows meet once; a source's length is added up from the shares of its documents' words.
    "F12_cosine": """SELECT doc_id, title, round(dot / (sqrt(x) * sqrt(y)), 6) AS cosine FROM (SELECT doc_id, title, dot, x, sum(share) OVER (PARTITION BY title) AS y FROM (SELECT doc_id, title, sum(d * t) AS dot, sum(d * d) AS x, sum(t * t / n) AS share
        FROM (SELECT w.doc_id, w.title, w.n, w.tf * ln(CAST(c.n AS DOUBLE) / w.df) AS d, w.of_source * ln(CAST(c.n AS DOUBLE) / w.df) AS t FROM (SELECT doc_id, title, tf, df, sum(tf) OVER (PARTITION BY token, title) AS of_source, count(*) OVER (PARTITION BY token, title) AS n
            FROM (SELECT doc_id, source AS title, token, tf, count(*) OVER (PARTITION BY token) AS df FROM doc_tf) v) w CROSS JOIN n_docs c) z GROUP BY doc_id, title) s WHERE title IS NOT NULL) r WHERE x > 0 AND y > 0""",
}


def same_row(text: str) -> str:
    for join, table in SAME_ROW.items():
        text = text.replace(f"FROM {join} AND ", f"FROM {table} WHERE ").replace(f"FROM {join}", f"FROM {table}")
    return text
