"""Mentions, candidate probes, features, ranking, relations, coreference, evaluation and lexicon, one query each."""

from __future__ import annotations

from .dialect import dual
from .queries_sql import FOLD
from .tables_link import COSINES, WINDOWS, cap

#: Prefixes of pages that are no articles, and of titles that are no aliases: fixed values.
ARTICLE_PREFIXES = ("Wikipedia:", "Template:", "Category:", ":Category:", "Help:", "Portal:", "File:", "Special:")
ALIAS_PREFIXES = ("Wikipedia:", "Template:", "Category:", ":Category:", "Help:", "Portal:")
#: Weights of relations by kind: fixed values.
WEIGHTS = {"link": 1.0, "infobox": 2.0, "title": 4.0, "coref": 10.0, "nominal": 20.0, "hard": 100.0}


def no_prefix(x: str, prefixes: tuple[str, ...]) -> str:
    return " AND ".join(f"NOT {x} LIKE '{p}%'" for p in prefixes)


def first_up(x: str) -> str:
    """The first letter as a capital; a sharp s has none that both dialects agree on."""
    return f"CASE WHEN {x} LIKE 'ß%' THEN 'ß' ELSE upper(substr({x}, 1, 1)) END"


def fold(x: str) -> str:
    """Lower case without accents."""
    return f"translate(translate(lower({x}), {FOLD}), 'ß', 's')"


def starts_capital(x: str) -> str:
    return f"{first_up(x)} || lower(substr({x}, 2))"


NUMBER = "CAST(CAST({} AS DECIMAL(18, 6)) AS VARCHAR(40))"
ALIAS = f"length(title) > 1 AND {no_prefix('title', ALIAS_PREFIXES)} AND NOT title LIKE 'List of %' AND length(translate(title, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,_-()', '')) < length(title) AND {no_prefix('target', ALIAS_PREFIXES)} AND NOT target LIKE '%(disambiguation)'"
ARTICLE = no_prefix("title", ARTICLE_PREFIXES)
#: A row of all probes of the fallback chain: lower priority wins; 'more' rows are added to the first list.
PROBES = f"""SELECT doc_id, pos, 0 AS priority, 0 AS more, tok || after AS probe FROM placed WHERE after = '''s' OR (tok LIKE '%''' AND after = 's')
    UNION ALL SELECT doc_id, pos, 1, 0, before || ' ' || tok FROM placed WHERE cap_before
    UNION ALL SELECT doc_id, pos, 2, 0, tok FROM placed
    UNION ALL SELECT doc_id, pos, 2, 1, tok || ' ' || {starts_capital('after')} FROM placed WHERE cap AND after = lower(after)
    UNION ALL SELECT doc_id, pos, 2, 1, replace(tok, '.', '') FROM placed WHERE cap AND tok LIKE '%.%' AND length(tok) < 5 AND tok = upper(tok)
    UNION ALL SELECT doc_id, pos, 3, 0, GSUB{{tok; '[.]+$'; ''}} FROM placed WHERE tok LIKE '%.'
    UNION ALL SELECT doc_id, pos, 4, 0, tok || '.' FROM placed WHERE tok LIKE '%Inc' OR tok LIKE '%Corp' OR tok LIKE '%Co'
    UNION ALL SELECT doc_id, pos, 4, 0, GSUB{{tok; '^''+|''+$'; ''}} FROM placed WHERE tok LIKE '''%' OR tok LIKE '%'''
    UNION ALL SELECT doc_id, pos, 5, 0, before FROM placed WHERE tok IN ('Inc.', 'Corp.', 'Co.')
    UNION ALL SELECT doc_id, pos, 6, 0, lower(substr(tok, 1, 1)) || substr(tok, 2) FROM placed WHERE cap AND translate(lower(tok), 'abcdefghijklmnopqrstuvwxyz0123456789', '') <> ''"""
OUTCOMES = """SELECT k, CAST(sum(tp) OVER (ORDER BY k) AS BIGINT) AS tp, CAST(sum(fp) OVER (ORDER BY k) AS BIGINT) AS fp, CAST(sum(mismatch) OVER (ORDER BY k) AS BIGINT) AS mismatch, t.tn, t.fn
    FROM (SELECT ks.k, sum(CASE WHEN c.title = g.gold THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN g.pos IS NOT NULL AND g.gold IS NULL THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN g.gold <> c.title THEN 1 ELSE 0 END) AS mismatch
        FROM (SELECT CAST(r_regionkey AS BIGINT) + 1 AS k FROM region) ks LEFT JOIN (SELECT doc_id, pos, title, place FROM ranked WHERE place <= 5) c ON c.place = ks.k
        LEFT JOIN (SELECT x.doc_id, x.pos, g.gold FROM decided x JOIN gold g ON g.doc_id = x.doc_id AND g.pos = x.pos WHERE x.link IS NOT NULL) g ON g.doc_id = c.doc_id AND g.pos = c.pos GROUP BY ks.k) h
    CROSS JOIN (SELECT CAST(sum(CASE WHEN g.gold IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN g.gold IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM decided x JOIN gold g ON g.doc_id = x.doc_id AND g.pos = x.pos WHERE x.link IS NULL) t"""
RATE = "round(CAST({0} AS DOUBLE) / nullif({1}, 0), 6)"
LINKER = "score AS own, score - coalesce(score2, 0e0) AS margin, CASE WHEN score2 IS NULL THEN 1e0 WHEN score + score2 > 0 THEN score / (score + score2) ELSE 0e0 END AS ratio, CASE WHEN score2 IS NULL THEN 1e0 ELSE 1 - 1 / (1 + exp(score - score2)) END AS logistic"
PROFILE = "c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i) SELECT e.vec_id, e.label, round(sum(e.x * c.m), 4) + 0e0 AS score FROM e JOIN c ON c.label = e.label AND c.i = e.i GROUP BY e.vec_id, e.label"
#: What parts words besides a backslash; a quote is doubled for SQL.
PUNCTUATION = "\n\t!\"#$%&''()*+,-./:;<=>?@[]^_`{|}~"
#: Plain text with single spaces, as the places of tokens count it.
PLAIN = "ltrim(GSUB{text; '[ \n]+'; ' '})"
XML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
EDIT = f"1 - CAST(levenshtein({fold('{0}')}, {fold('{1}')}) AS DOUBLE) / greatest(length({{0}}), length({{1}}))"
RESTRICTED = "SELECT a.doc_id, a.pos AS left_pos, b.pos AS right_pos, a.title AS t1, b.title AS t2, a.place AS place1, b.place AS place2 FROM ranked a JOIN ranked b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.title <> b.title"
RELATIONS = f"SELECT r.doc_id, r.left_pos, r.right_pos, r.t1, r.t2, r.place1, r.place2, CASE WHEN s.two_way THEN 2 ELSE 1 END AS hits FROM ({RESTRICTED}) r JOIN t_pairwise_sim s ON s.a = least(r.t1, r.t2) AND s.b = greatest(r.t1, r.t2)"

QUERIES: dict[str, str | tuple[str, str]] = {
    # Sources, sinks and the knowledge base.
    "S6_title_categories": dual("SELECT a.title, JOINED{a.lang; ','; a.lang} AS categories FROM (SELECT DISTINCT t.title, regexp_extract(p.url, '[.](com|net|org)/([a-z]+)/', 2) AS lang FROM anchors t JOIN pages p ON p.page_id = t.page_id) a WHERE a.lang <> '' GROUP BY a.title"),
    "S7_title_entries": "SELECT t.title, CAST(count(DISTINCT t.page_id) AS BIGINT) AS prevalence, min(regexp_extract(p.url, '[.](com|net|org)/([a-z]+)/', 2)) AS nationality, min(t.page_id) AS first_page FROM anchors t JOIN pages p ON p.page_id = t.page_id GROUP BY t.title",
    "S17_lines": dual("SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM (SELECT doc_id, PARTS{text; '\n'} AS line FROM documents) x GROUP BY doc_id"),
    "S18_line_count": dual("SELECT count(*) AS n FROM (SELECT PARTS{html; '<p>'} AS line FROM pages) x"),
    "S19_page_ids": dual("SELECT title, max(id) AS id FROM (SELECT regexp_extract(url, '//([^/]+)/', 1) AS title, TRY_CAST(regexp_extract(url, '/([0-9]+)([?#]|$)', 1) AS BIGINT) AS id FROM pages) x WHERE id IS NOT NULL GROUP BY title"),
    "O1_entities": dual(f"SELECT r.doc_id, r.pos, '<Entity><Surface>' || {XML.format('r.surface')} || '</Surface><Score>' || {NUMBER.format('max(CASE WHEN r.place = 1 THEN r.score END)')} || '</Score><Top>' || {XML.format('min(CASE WHEN r.place = 1 THEN r.title END)')} || '</Top><Candidates>' || JOINED{{{XML.format('r.title')}; ' '; r.place}} || '</Candidates></Entity>' AS xml FROM ranked r GROUP BY r.doc_id, r.pos, r.surface"),
    "O2_markup": f"SELECT doc_id, pos, CASE WHEN linkability < 0.05 OR tok = lower(tok) THEN '<b>' || {XML.format('tok')} || '</b>' ELSE '<a href=\"' || {XML.format('top')} || '\">' || {XML.format('tok')} || '</a>' END AS html FROM best WHERE linkability >= 0.01",
    "O3_mention_lines": "SELECT x.doc_id, x.pos, x.surface || ' -> ' || coalesce(x.link, '*null*') || ' / ' || coalesce(g.gold, '*null*') || CASE WHEN coalesce(x.link, '*null*') = coalesce(g.gold, '*null*') THEN ' correct' ELSE ' wrong' END AS line FROM decided x JOIN gold g ON g.doc_id = x.doc_id AND g.pos = x.pos",
    "O5_feature_dump": f"SELECT doc_id, pos, title, '{{\"p_title\":' || {NUMBER.format('p_title')} || ',\"p_surface\":' || {NUMBER.format('p_surface')} || ',\"rank\":' || CAST(rank AS VARCHAR(20)) || ',\"score\":' || {NUMBER.format('score')} || '}}' AS features FROM scored",
    "O6_annotation_lines": f"SELECT doc_id, s, '<Form>' || {XML.format('name')} || '</Form><Start>' || CAST(cs AS VARCHAR(20)) || '</Start><End>' || CAST(ce AS VARCHAR(20)) || '</End><Label>' || label || '</Label>' AS line FROM named",
    "O9_training_lines": f"SELECT c.doc_id, c.pos, c.title, CASE WHEN c.title = g.gold THEN '1' ELSE '-1' END || ' 1:' || {NUMBER.format('c.p_title')} || ' 2:' || {NUMBER.format('c.p_surface')} || ' 3:' || {NUMBER.format('CAST(c.rank AS DOUBLE) / m.largest')} AS line FROM candidates c JOIN gold g ON g.doc_id = c.doc_id AND g.pos = c.pos CROSS JOIN (SELECT max(rank) AS largest FROM candidates) m",
    "O10_error_report": dual(f"SELECT x.doc_id, x.pos, CASE WHEN g.gold IS NULL THEN 'spurious' WHEN x.link IS NULL THEN 'missed' ELSE 'wrong' END AS mistake, x.link AS predicted, g.gold, substr(d.plain, CAST(greatest(p.cs - 50, 0) + 1 AS INT), CAST(p.cs - greatest(p.cs - 50, 0) + p.cl + 50 AS INT)) AS context FROM decided x JOIN gold g ON g.doc_id = x.doc_id AND g.pos = x.pos JOIN placed p ON p.doc_id = x.doc_id AND p.pos = x.pos JOIN (SELECT doc_id, {PLAIN} AS plain FROM documents) d ON d.doc_id = x.doc_id WHERE coalesce(x.link, '*null*') <> coalesce(g.gold, '*null*')"),
    "O10_mistake_counts": "SELECT mistake, count(*) AS n FROM (SELECT CASE WHEN g.gold IS NULL THEN 'spurious' WHEN x.link IS NULL THEN 'missed' ELSE 'wrong' END AS mistake FROM decided x JOIN gold g ON g.doc_id = x.doc_id AND g.pos = x.pos WHERE coalesce(x.link, '*null*') <> coalesce(g.gold, '*null*')) y GROUP BY mistake",
    "K1_valid_titles": f"SELECT title, target FROM (SELECT src AS title, dst AS target FROM variants UNION SELECT title, title FROM raw_titles) x WHERE {ALIAS}",
    "K4_article_titles": f"SELECT title FROM raw_titles WHERE {ARTICLE}",
    "K5_title_index": f"SELECT t.title, translate(lower(replace(replace(t.title, '-', '_'), ' ', '_')), {FOLD}) AS url, t.n, v.dst AS redirect FROM raw_titles t LEFT JOIN variants v ON v.src = t.title WHERE t.n >= 0 AND {ARTICLE.replace('title', 't.title')}",
    "K6_extract_and_index": f"SELECT clean, count(*) AS n_titles, min(target) AS target FROM (SELECT replace(title, ' ', '_') AS clean, target FROM (SELECT r.title, coalesce(v.dst, r.title) AS target FROM raw_titles r LEFT JOIN variants v ON v.src = r.title) x WHERE {ALIAS}) y GROUP BY clean",
    "K7_index_without_prefix": "SELECT title, n FROM raw_titles WHERE NOT title LIKE 'The%' AND NOT title LIKE 'En%'",
    "K8_ambiguous_targets": dual("SELECT surface, count(*) AS n_targets, JOINED{title; ' '; title} AS targets FROM pair_counts GROUP BY surface HAVING count(*) > 1"),
    "K12_similarity_lines": dual(f"SELECT GET{{SPLIT{{line; ' '}}; 1}} AS pair, CAST(GET{{SPLIT{{line; ' '}}; 2}} AS DOUBLE) AS in_pmi FROM (SELECT CAST(a AS VARCHAR(20)) || '_' || CAST(b AS VARCHAR(20)) || ' ' || {NUMBER.format('in_pmi')} AS line FROM pairwise_sim) x"),
    "K14_spell_index": dual(f"SELECT title, gram, count(*) AS times FROM (SELECT title, substr(word, CAST(i AS INT), CAST(n AS INT)) AS gram FROM (SELECT title, word, n, SEQ{{1; length(word) - n + 1}} AS i FROM (SELECT title, word, SEQ{{1; least(5, length(word))}} AS n FROM (SELECT title, PARTS{{translate(lower(title), {FOLD}); '[ _]'}} AS word FROM raw_titles) a WHERE word <> '') b) c) d GROUP BY title, gram"),
    # Lookups and title search.
    "L2_surface_lookup": "SELECT m.doc_id, m.pos, f.linked_count, f.total_count, f.ambiguity FROM mentions m JOIN surface_forms f ON f.surface = m.surface",
    "L3_title_lookup": "SELECT l.src, p.p_name, o.n AS n_out, i.n AS n_in FROM (SELECT DISTINCT src FROM links) l JOIN part p ON p.p_partkey = l.src LEFT JOIN out_sizes o ON o.id = l.src LEFT JOIN in_sizes i ON i.id = l.src",
    "L9_normalised_titles": f"SELECT x.title, CASE WHEN x.title = '' THEN '*null*' ELSE {first_up('coalesce(v.dst, x.title)')} || substr(replace(replace(replace(replace(replace(coalesce(v.dst, x.title), ' ', '_'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), 2) END AS normal FROM (SELECT DISTINCT replace(title, 'http://en.wikipedia.org/wiki/', '') AS title FROM anchors) x LEFT JOIN variants v ON v.src = x.title",
    "L10_url_form": dual(f"SELECT q.url, coalesce(max(CASE WHEN t.title = q.title THEN t.title END), BEST{{t.title; t.n, t.title}}) AS found FROM (SELECT DISTINCT title, translate(lower(replace(replace(title, '-', '_'), ' ', '_')), {FOLD}) AS url FROM (SELECT title FROM raw_titles UNION SELECT title || CASE WHEN title LIKE '%Inc' OR title LIKE '%Corp' THEN '.' ELSE '' END FROM raw_titles) a) q JOIN (SELECT r.title, r.n, translate(lower(replace(replace(r.title, '-', '_'), ' ', '_')), {FOLD}) AS url FROM raw_titles r) t ON t.url = q.url GROUP BY q.url, q.title"),
    "L11_title_search": dual("""WITH docs AS (SELECT p_name AS title, min(p_partkey) AS id, max(p_type) AS redirect FROM part GROUP BY p_name), words AS (SELECT title, word, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT title, PARTS{title; ' '} AS word FROM docs UNION ALL SELECT title, title FROM docs WHERE title LIKE '% %') x GROUP BY title, word),
        lens AS (SELECT title, sum(tf) AS size FROM words GROUP BY title), dfs AS (SELECT word, CAST(count(*) AS DOUBLE) AS df FROM words GROUP BY word), means AS (SELECT avg(size) AS mean, CAST(count(*) AS DOUBLE) AS n FROM lens), hits AS (
        SELECT q.title AS query, w.title, sum(ln(1 + (m.n - d.df + 0.5) / (d.df + 0.5)) * w.tf * 2.2 / (w.tf + 1.2 * (0.25 + 0.75 * l.size / m.mean))) AS score FROM words q JOIN words w ON w.word = q.word JOIN dfs d ON d.word = q.word JOIN lens l ON l.title = w.title CROSS JOIN means m GROUP BY q.title, w.title)
        SELECT query, title, score, CAST(place AS BIGINT) AS place FROM (SELECT query, title, round(score, 5) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 5) DESC, title) AS place FROM hits) r WHERE place <= 20 AND score > 0.5"""),
    "L13_title_by_id": "SELECT l.dst AS id, p.p_name AS title FROM (SELECT DISTINCT dst FROM links) l JOIN part p ON p.p_partkey = l.dst",
    "L15_titles_kept": "SELECT c.surface, c.title, CAST(row_number() OVER (PARTITION BY c.surface ORDER BY c.rank) AS BIGINT) AS rank FROM surface_candidates c LEFT ANTI JOIN (SELECT surface FROM pair_counts GROUP BY surface HAVING count(*) > 3) d ON d.surface = lower(c.title) WHERE NOT c.title LIKE '%(disambiguation)'",
    "L16_relation_search": dual("SELECT q.id, 'from' AS side, r.arg2 AS other, CAST(sum(r.score) AS BIGINT) AS score FROM (SELECT p_partkey AS id, GET{SPLIT{p_name; ' '}; 1} AS word FROM part) q JOIN triples r ON r.arg1 = q.id JOIN part p ON p.p_partkey = r.arg1 WHERE ' ' || p.p_name || ' ' LIKE '% ' || q.word || ' %' GROUP BY 1, 2, 3 UNION ALL SELECT s.s_suppkey, 'to', r.arg1, CAST(sum(r.score) AS BIGINT) FROM supplier s JOIN triples r ON r.arg2 = s.s_suppkey GROUP BY 1, 2, 3"),
    "L17_text_by_text": dual("SELECT word, pred, side, CAST(sum(score) AS BIGINT) AS score FROM (SELECT w.word, r.pred, 'from' AS side, r.score FROM triples r JOIN (SELECT p_partkey, PARTS{p_name; ' '} AS word FROM part) w ON w.p_partkey = r.arg1 UNION ALL SELECT s.s_name, r.pred, 'to', r.score FROM triples r JOIN supplier s ON s.s_suppkey = r.arg2) x GROUP BY word, pred, side"),
    "L18_consolidated_triples": "SELECT arg1, arg2, score, pred, round(exp(0.2e0 * score) / sum(exp(0.2e0 * score)) OVER (PARTITION BY arg1), 6) AS share FROM (SELECT arg1, arg2, round(CAST(sum(CASE WHEN pred = 'LINK' THEN 0.2 * score ELSE 1.0 * score END) AS DOUBLE), 6) AS score, coalesce(max(CASE WHEN pred <> 'LINK' THEN pred END), 'LINK') AS pred FROM triples GROUP BY arg1, arg2) x",
    "L20_spell_check": dual(f"SELECT query, found, alike FROM (SELECT query, found, alike, row_number() OVER (PARTITION BY query ORDER BY alike DESC, found) AS best FROM (SELECT query, found, round({EDIT.format('query', 'found')}, 6) AS alike, row_number() OVER (PARTITION BY query ORDER BY grams DESC, found) AS k FROM (SELECT q.query, g.title AS found, count(*) AS grams FROM (SELECT query, SEQ{{1; length(query) - 2}} AS i FROM (SELECT DISTINCT substr(title, 1, 2) || substr(title, 4) AS query FROM raw_titles WHERE length(title) > 5) a) q JOIN (SELECT title, SEQ{{1; length(title) - 2}} AS i FROM raw_titles WHERE length(title) > 2) g ON substr(g.title, CAST(g.i AS INT), 3) = substr(q.query, CAST(q.i AS INT), 3) WHERE substr(g.title, 1, 1) = substr(q.query, 1, 1) GROUP BY q.query, g.title) h) r WHERE k <= 5) s WHERE best = 1 AND alike > 0.7"),
    "L22_title_categories": "SELECT c.surface, c.title, coalesce(a.category, '') AS category FROM surface_candidates c LEFT JOIN (SELECT t.title, min(regexp_extract(p.url, '[.](com|net)/([a-z]+)/', 2)) AS category FROM anchors t JOIN pages p ON p.page_id = t.page_id GROUP BY t.title) a ON a.title = c.title",
    "L23_category_words": dual("SELECT k.c_mktsegment AS category, w.word, count(*) AS n FROM (SELECT DISTINCT p_type, PARTS{lower(p_type); '[^a-z]+'} AS word FROM part) w JOIN (SELECT c_mktsegment, lower(c_mktsegment) AS word FROM customer UNION ALL SELECT p_type, lower(p_type) FROM part) k ON k.word = w.word GROUP BY 1, 2"),
    "L25_index_terms": dual("SELECT doc_id, term, count(*) AS n_items FROM (SELECT doc_id, name, PARTS{low; ' '} AS term FROM named UNION SELECT doc_id, name, GSUB{name; '[^A-Z]'; ''} FROM named WHERE e - s > 1 UNION SELECT doc_id, name, upper(substr(head, 1, 1) || substr(last, 1, 1)) FROM named WHERE e - s = 2) x WHERE term <> '' GROUP BY doc_id, term"),
    "L24_index_search": dual("SELECT q.doc_id, q.low AS query, q.n_words, count(*) AS n_found, min(q.found) AS first_found FROM (SELECT a.doc_id, a.low, a.n_words, b.low AS found FROM (SELECT doc_id, low, n_words, PARTS{low; ' '} AS word FROM (SELECT DISTINCT doc_id, low, e - s AS n_words FROM named) x) a JOIN (SELECT DISTINCT doc_id, low, word FROM (SELECT doc_id, low, PARTS{low; ' '} AS word FROM named) y) b ON b.doc_id = a.doc_id AND b.word = a.word GROUP BY a.doc_id, a.low, a.n_words, b.low HAVING count(DISTINCT a.word) >= a.n_words) q GROUP BY q.doc_id, q.low, q.n_words"),
    # Scalars.
    "F1_aggressive_tokens": dual(f"SELECT doc_id, CAST(length(x) - length(replace(x, ' ', '')) + CASE WHEN x = '' THEN 0 ELSE 1 END AS BIGINT) AS n_tokens, md5(x) AS key FROM (SELECT doc_id, trim(GSUB{{y; ' +'; ' '}}) AS x FROM (SELECT doc_id, translate(text, '{PUNCTUATION}' || chr(92), '{' ' * (len(PUNCTUATION) - 1)}' || ' ') AS y FROM documents) z) w"),
    "F2_tokens": dual("SELECT doc_id, count(*) AS n, CAST(max(length(tok)) AS BIGINT) AS longest FROM tokens GROUP BY doc_id"),
    "F7_token_sets": dual("SELECT surface, GSUB{surface; '[^A-Za-z0-9]'; ''} AS stripped, trim(GSUB{lower(surface); '[^a-z0-9]+'; ' '}) AS parsed, CAST(length(GSUB{surface; '[A-Za-z0-9]'; ''}) AS BIGINT) AS n_other FROM (SELECT DISTINCT surface FROM token_surfaces) x"),
    "F8_shingles": dual("SELECT title, CAST(n AS BIGINT) AS n, count(DISTINCT gram) AS n_grams, min(gram) AS first_gram FROM (SELECT title, n, substr(title, CAST(i AS INT), CAST(n AS INT)) AS gram FROM (SELECT title, n, SEQ{1; length(title) - n + 1} AS i FROM (SELECT title, SEQ{1; least(5, length(title))} AS n FROM raw_titles) a) b) c GROUP BY title, n"),
    "F13_unit_cosine": "SELECT p.a, p.b, round(coalesce(d.dot, 0) / sqrt(CAST(x.n AS DOUBLE) * y.n), 6) AS cosine FROM linked_pairs p JOIN out_sizes x ON x.id = p.a JOIN out_sizes y ON y.id = p.b LEFT JOIN (SELECT a, b, CAST(i AS DOUBLE) AS dot FROM out_shared) d ON d.a = p.a AND d.b = p.b",
    "F15_link_weights": "SELECT u.id, 1e0 AS unweighted, CAST(coalesce(i.n, 0) AS DOUBLE) AS prevalence, round(CASE WHEN i.n IS NULL THEN 0.01 ELSE ln((CAST(z.t AS DOUBLE) + 1) / i.n) END, 6) AS log_specificity, round(CASE WHEN i.n IS NULL THEN 0.01 ELSE CAST(1 AS DOUBLE) / i.n END, 9) AS specificity FROM (SELECT src AS id FROM links UNION SELECT dst FROM links) u LEFT JOIN in_sizes i ON i.id = u.id CROSS JOIN (SELECT n AS t FROM titles_n) z",
    "F17_shapes": dual(f"SELECT DISTINCT tok, tok = lower(tok) AS no_upper, {cap('tok')} AS capitalised, tok <> '' AND substr(tok, 1, 1) = lower(substr(tok, 1, 1)) AND substr(tok, 1, 1) BETWEEN 'a' AND 'z' AS starts_lower, CAST(length(GSUB{{tok; '[^A-Z]'; ''}}) AS BIGINT) AS n_capitals, {starts_capital('tok')} AS recapitalised FROM tokens"),
    "F19_acronyms": dual("SELECT c_custkey, GSUB{substr(name, 1, greatest(length(name) - 5, 0)); '[^A-Z]'; ''} || " + " || ".join(f"CASE WHEN length(name) >= {k} AND substr(name, length(name) - {k - 1}, 1) BETWEEN 'A' AND 'Z' AND NOT (name LIKE '%.' OR substr(name, length(name) - {k - 1}) LIKE '%Inc%' OR substr(name, length(name) - {k - 1}) LIKE '%Corp%' OR substr(name, length(name) - {k - 1}) LIKE '%Ltd%') THEN substr(name, length(name) - {k - 1}, 1) ELSE '' END" for k in (5, 4, 3, 2, 1)) + " AS capitals, substr(name, 1, 1) || upper(substr(tail, 1, 1)) AS initials FROM (SELECT c_custkey, replace(c_name, '#', ' ') || CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Corp' WHEN 2 THEN ' Ltd' ELSE ' AG' END AS name, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'Inc.' WHEN 1 THEN 'Corp' WHEN 2 THEN 'Ltd' ELSE 'AG' END AS tail FROM customer) x"),
    "F24_normalised_phrases": "SELECT DISTINCT tok, CASE WHEN cap AND translate(lower(tok), 'abcdefghijklmnopqrstuvwxyz0123456789', '') <> '' THEN lower(substr(tok, 1, 1)) || substr(tok, 2) ELSE tok END AS phrase FROM placed",
    "F25_cleaned": dual("SELECT doc_id, md5(GSUB{text; '[^A-Za-z0-9.,;:!?()]'; ' '}) AS key FROM documents"),
    "F27_span_predicates": "SELECT doc_id, s, e, coalesce(s < e_before, FALSE) AS overlaps, coalesce(e <= e_before AND s >= s_before, FALSE) AS contained, coalesce(s - e_before, -1) AS distance, e - s AS n_tokens, CAST(cs AS VARCHAR(20)) || '_' || CAST(e - s AS VARCHAR(20)) AS place FROM (SELECT doc_id, s, e, cs, lag(s) OVER (PARTITION BY doc_id ORDER BY s, e) AS s_before, lag(e) OVER (PARTITION BY doc_id ORDER BY s, e) AS e_before FROM named) x",
    "F27_span_overlaps": "SELECT doc_id, pos AS pos1, next1 AS pos2, CASE WHEN next2 <= pos + 2 THEN next2 ELSE -1 END AS pos3 FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next1, lead(pos, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS next2 FROM mentions WHERE ambiguity > 1) x WHERE next1 <= pos + 2",
    "F28_match_flags": f"SELECT r.doc_id, r.pos, r.surface = lower(r.title) AS perfect, r.p_surface < 1e-6 AS no_surface_share, levenshtein({fold('r.surface')}, {fold('r.title')}) <= 1 AS fuzzy, r.linkability IS NULL AS unmapped, r.score > 0 AS has_potential FROM ranked r WHERE r.place = 1",
    "F29_boundaries": "SELECT doc_id, pos, before IS NULL OR before LIKE '%,' OR starts AS left_boundary, after IS NULL OR tok LIKE '%,' OR ends AS right_boundary, tok = upper(tok) AND tok <> lower(tok) AS all_caps, cap AND NOT cap_before AS top_level, tok = lower(tok) AS no_entity, starts AS first_in_sentence FROM placed",
    "F34_normalised_counts": "SELECT s.title, s.token, round(CAST(s.tf AS DOUBLE) / sum(s.tf) OVER (PARTITION BY s.title), 9) AS share, v.df >= 5 AS known FROM source_counts s JOIN vocab v ON v.token = s.token",
    # Mentions.
    "M0_tagged_spans": "SELECT doc_id, s, e, label, name FROM named",
    "M1_named_mentions": "SELECT doc_id, s, e, cs, ce - cs AS n_chars, name, 'NER' AS kind, label FROM named",
    "M2_outermost_spans": "SELECT doc_id, s, e FROM (SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT doc_id, pos AS s, pos + 1 AS e FROM mentions UNION SELECT doc_id, s, e FROM chunks UNION SELECT doc_id, s, e FROM named) w) x WHERE reach IS NULL OR e > reach",
    "M4_windows": dual("SELECT c.doc_id, t.pos AS s, t.pos + w.n AS e FROM (SELECT doc_id, run, s, e FROM (SELECT doc_id, min(pos) AS s, max(pos) + 1 AS e, run FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM mentions) x GROUP BY doc_id, run) y) c JOIN (SELECT m.doc_id, m.pos, m.pos - row_number() OVER (PARTITION BY m.doc_id ORDER BY m.pos) AS run, p.cap, min(CASE WHEN p.cap THEN m.pos END) OVER (PARTITION BY m.doc_id ORDER BY m.pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_cap FROM mentions m JOIN placed p ON p.doc_id = m.doc_id AND p.pos = m.pos) t ON t.doc_id = c.doc_id AND t.run = c.run JOIN (SELECT n_regionkey + 1 AS n FROM nation WHERE n_nationkey < 0 UNION SELECT 1 UNION SELECT 2 UNION SELECT 3 UNION SELECT 4 UNION SELECT 5 UNION SELECT 6) w ON w.n <= c.e - t.pos WHERE NOT (t.pos = c.s AND t.pos + w.n = c.e) AND (t.cap OR t.next_cap IS NULL OR t.pos + w.n <= t.next_cap)"),
    "M8_long_names": "SELECT n.doc_id, n.s, n.e, n.name FROM named n JOIN placed f ON f.doc_id = n.doc_id AND f.pos = n.s JOIN placed a ON a.doc_id = n.doc_id AND a.pos = n.e LEFT JOIN stops t ON t.token = lower(f.before) WHERE n.e - n.s > 1 AND length(n.name) - length(replace(n.name, ',', '')) <= 1 AND NOT a.starts AND NOT (f.cap_before AND t.token IS NULL AND NOT f.starts)",
    "M9_aligned_spans": dual("SELECT g.doc_id, g.c, min(p.pos) AS s, max(p.pos) + 1 AS e FROM (SELECT doc_id, cs AS c, cs + (ce - cs) AS stop, SEQ{CAST(floor(cs / 64.0) AS BIGINT); CAST(floor((ce - 1) / 64.0) AS BIGINT)} AS stretch FROM named) g JOIN (SELECT doc_id, pos, cs, cl, SEQ{CAST(floor(cs / 64.0) AS BIGINT); CAST(floor((cs + cl - 1) / 64.0) AS BIGINT)} AS stretch FROM placed) p ON p.doc_id = g.doc_id AND p.stretch = g.stretch AND p.cs < g.stop AND p.cs + p.cl > g.c GROUP BY g.doc_id, g.c"),
    "M10_eligible": "SELECT p.doc_id, p.pos, c.surface IS NOT NULL AS has_candidates, r.title IS NOT NULL AS is_title FROM placed p LEFT JOIN linked_counts c ON c.surface = p.surface LEFT JOIN raw_titles r ON r.title = p.tok LEFT ANTI JOIN stops t ON t.token = p.surface WHERE c.surface IS NOT NULL OR r.title IS NOT NULL OR (p.cap AND NOT p.cap_before AND NOT p.starts)",
    "M11_local_contexts": "SELECT doc_id, pos, " + ", ".join(f"CAST(sum(c{w}) AS BIGINT) AS n{w}" for w in WINDOWS) + ", CAST(sum(CASE WHEN c200 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_distinct FROM around GROUP BY doc_id, pos",
    "M12_types_by_surface": "SELECT p.doc_id, p.pos, n.label FROM (SELECT doc_id, pos, surface FROM placed WHERE NOT cap) p JOIN (SELECT doc_id, low, max_by(label, s) AS label FROM named WHERE e - s = 1 GROUP BY doc_id, low) n ON n.doc_id = p.doc_id AND n.low = p.surface",
    "M13_sorted_mentions": "SELECT doc_id, s, e, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, e) AS BIGINT) AS place FROM (SELECT doc_id, s, e FROM named UNION SELECT doc_id, s, e FROM chunks) x",
    "M14_augmented_types": "SELECT m.doc_id, m.pos, m.top, CASE WHEN k.category IN ('en') THEN 'PER' WHEN k.category IN ('de', 'fr') THEN 'LOC' ELSE 'ORG' END AS label FROM (SELECT b.doc_id, b.pos, b.top FROM best b JOIN placed p ON p.doc_id = b.doc_id AND p.pos = b.pos WHERE p.cap AND p.starts) m JOIN (SELECT t.title, max(regexp_extract(p.url, '[.](com|net)/([a-z]+)/', 2)) AS category FROM anchors t JOIN pages p ON p.page_id = t.page_id GROUP BY t.title) k ON k.title = m.top WHERE k.category <> ''",
    # Candidate probes.
    "G2_exact_only": "SELECT p.doc_id, p.pos, c.title FROM placed p JOIN pair_counts c ON c.surface = p.tok WHERE p.tok = p.surface",
    "G3_possessive": "SELECT DISTINCT title || '''s' AS probe, title FROM raw_titles UNION SELECT DISTINCT tok || '''s', surface FROM tokens t JOIN (SELECT surface FROM linked_counts) l ON l.surface = lower(t.tok)",
    "G4_premodified": "SELECT p.doc_id, p.pos, p.before || ' ' || p.tok AS probe FROM placed p JOIN (SELECT surface FROM pair_counts GROUP BY surface HAVING count(*) > 2) f ON f.surface = p.surface WHERE p.cap_before",
    "G5_recapitalised": f"SELECT p.doc_id, p.pos, p.tok || ' ' || {starts_capital('p.after')} AS probe FROM placed p LEFT ANTI JOIN stops t ON t.token = p.surface WHERE p.cap AND p.after = lower(p.after)",
    "G6_undotted": "SELECT DISTINCT tok, replace(tok, '.', '') AS probe FROM tokens WHERE tok LIKE '%.%' AND ((tok <> 'I' AND length(tok) < 5 AND tok = upper(tok)) OR length(tok) - length(replace(tok, '.', '')) >= greatest(2, length(tok) / 2))",
    "G7_stripped_dots": dual("SELECT p.doc_id, p.pos, GSUB{p.tok; '[.]+$'; ''} AS probe, r.n FROM placed p LEFT ANTI JOIN raw_titles x ON x.title = p.tok JOIN raw_titles r ON r.title = GSUB{p.tok; '[.]+$'; ''} WHERE p.tok LIKE '%.'"),
    "G8_corrected": dual("SELECT DISTINCT title, CASE WHEN title LIKE '%Inc' OR title LIKE '%Corp' OR title LIKE '%Co' THEN title || '.' ELSE GSUB{title; '^''+|''+$'; ''} END AS probe FROM (SELECT title FROM raw_titles UNION SELECT title || ' Corp' FROM raw_titles UNION SELECT '''' || title || '''' FROM raw_titles) x"),
    "G9_unqualified": dual("SELECT name, GSUB{name; ' [^ ]*$'; ''} AS probe FROM (SELECT s_name || ' Inc.' AS name FROM supplier UNION ALL SELECT s_name || ' Co.' FROM supplier) x"),
    "G10_uncapitalised": "SELECT DISTINCT p.tok, lower(substr(p.tok, 1, 1)) || substr(p.tok, 2) AS probe, l.linked_count FROM placed p JOIN linked_counts l ON l.surface = lower(p.tok) WHERE p.cap",
    "G12_query_lines": dual("SELECT surface, JOINED{title; '\t'; rank} AS line FROM surface_candidates WHERE rank <= 20 GROUP BY surface"),
    "G13_title_candidates": "SELECT p.doc_id, p.pos, r.title, 0e0 AS p_title, 0e0 AS p_surface, 1e-5 AS unseen_mass, -5e0 AS log_appear, -10e0 AS log_web, CAST(1 AS BIGINT) AS ambiguity FROM placed p JOIN raw_titles r ON r.title = p.tok LEFT ANTI JOIN linked_counts l ON l.surface = p.tok",
    "G_probe_chain": dual(f"SELECT doc_id, pos, priority, title, n FROM (SELECT p.doc_id, p.pos, CAST(p.priority AS BIGINT) AS priority, r.title, r.n, min(p.priority) OVER (PARTITION BY p.doc_id, p.pos) AS first FROM ({PROBES}) p JOIN raw_titles r ON r.title = p.probe) x WHERE priority = first"),
    # Features.
    "X1_lexical": f"SELECT x.doc_id, x.pos, x.title, {COSINES} FROM candidates x LEFT JOIN title_lens t ON t.title = x.title LEFT JOIN (SELECT c.*, l.n20, l.n50, l.n100, l.n150, l.n200 FROM contexts c JOIN context_lens l ON l.doc_id = c.doc_id AND l.pos = c.pos) c ON c.doc_id = x.doc_id AND c.pos = x.pos AND c.token = t.token GROUP BY x.doc_id, x.pos, x.title",
    "X2_reweighted": f"SELECT x.doc_id, x.pos, x.title, {COSINES} FROM candidates x LEFT JOIN title_rw t ON t.surface = x.surface AND t.title = x.title LEFT JOIN (SELECT c.*, l.n20, l.n50, l.n100, l.n150, l.n200 FROM contexts c JOIN context_lens l ON l.doc_id = c.doc_id AND l.pos = c.pos) c ON c.doc_id = x.doc_id AND c.pos = x.pos AND c.token = t.token GROUP BY x.doc_id, x.pos, x.title",
    "V1_vectors": "SELECT doc_id, pos, title, CASE WHEN place = 1 THEN 1e0 ELSE 0e0 END AS f_top, CAST(rank AS DOUBLE) AS f_rank, round(p_surface, 6) AS f_p_surface, round(p_title, 6) AS f_p_title, round(p_title * p_surface, 6) AS f_title_by_surface, round(p_title * linkability, 6) AS f_title_by_linkability FROM ranked",
    "P1_profile": (
        "WITH e AS (SELECT vec_id, label, i, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) t AS i, x), " + PROFILE,
        "WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), " + PROFILE,
    ),
    "C1_kept_candidates": "SELECT doc_id, pos, title, place FROM ranked WHERE place <= 3",
    "C2_context_windows": "SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id ORDER BY cs RANGE BETWEEN 1999 PRECEDING AND 1999 FOLLOWING) - 1 AS n_context FROM mention_places",
    "C3_pair_features": "SELECT a, b, round(in_pmi, 6) AS in_pmi, round(in_ngd, 6) + 0e0 AS in_ngd, round(out_pmi, 6) AS out_pmi, round(out_ngd, 6) + 0e0 AS out_ngd, two_way, CASE WHEN two_way THEN round(in_pmi, 6) ELSE 0e0 END AS in_pmi2, CASE WHEN two_way THEN round(in_ngd, 6) + 0e0 ELSE 0e0 END AS in_ngd2, CASE WHEN two_way THEN round(out_pmi, 6) ELSE 0e0 END AS out_pmi2, CASE WHEN two_way THEN round(out_ngd, 6) + 0e0 ELSE 0e0 END AS out_ngd2 FROM t_pairwise_sim",
    "C4_selected_contexts": "SELECT r.doc_id, r.pos, CASE WHEN r.p_title >= 0.99 THEN r.title WHEN p.cap THEN r.title WHEN r.linkability >= 0.05 THEN r.title END AS context FROM ranked r JOIN placed p ON p.doc_id = r.doc_id AND p.pos = r.pos WHERE r.place = 1",
    "C5_coherence": """WITH tops AS (SELECT r.doc_id, r.pos, m.cs, r.title FROM ranked r JOIN mention_places m ON m.doc_id = r.doc_id AND m.pos = r.pos WHERE r.place = 1), counted AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id ORDER BY cs RANGE BETWEEN 1999 PRECEDING AND 1999 FOLLOWING) AS around, count(*) OVER (PARTITION BY doc_id, title ORDER BY cs RANGE BETWEEN 1999 PRECEDING AND 1999 FOLLOWING) AS same FROM tops),
        near AS (SELECT a AS title, b AS other, in_pmi, in_ngd, out_pmi, two_way FROM t_pairwise_sim UNION ALL SELECT b, a, in_pmi, in_ngd, out_pmi, two_way FROM t_pairwise_sim),
        sums AS (SELECT k.doc_id, k.pos, k.title, sum(s.in_pmi) AS in_pmi, max(s.in_ngd) AS in_ngd, sum(CASE WHEN s.two_way THEN s.out_pmi ELSE 0e0 END) AS two_way FROM (SELECT r.doc_id, r.pos, r.title, m.cs FROM ranked r JOIN mention_places m ON m.doc_id = r.doc_id AND m.pos = r.pos WHERE r.place <= 3) k JOIN near s ON s.title = k.title JOIN tops t ON t.doc_id = k.doc_id AND t.title = s.other AND t.pos <> k.pos AND abs(t.cs - k.cs) < 2000 GROUP BY k.doc_id, k.pos, k.title)
        SELECT c.doc_id, c.pos, s.title, c.around - c.same AS n_context, round(s.in_pmi / nullif(c.around - c.same, 0) + 1e-10, 5) AS avg_in_pmi, round(greatest(s.in_ngd, 0e0), 6) + 0e0 AS max_in_ngd, round(s.two_way / nullif(c.around - c.same, 0) + 1e-10, 5) AS avg_two_way FROM counted c JOIN sums s ON s.doc_id = c.doc_id AND s.pos = c.pos""",
    # Ranking and linking.
    "R2_linear_scores": "SELECT doc_id, pos, title, score FROM scored",
    "R3_predictions": "SELECT doc_id, pos, title, CASE WHEN score > 1 THEN 1 ELSE -1 END AS label, round(1 / (1 + exp(1 - score)), 6) AS probability FROM scored",
    "R5_next_level": "SELECT doc_id, pos, title, CASE WHEN place = 1 THEN 1 ELSE 0 END AS was_top, round(score + CASE WHEN place = 1 THEN 0.25e0 ELSE 0e0 END, 6) AS next_score FROM ranked",
    "R6_linker_features": "SELECT doc_id, pos, title, round(own, 6) AS score, round(margin, 6) AS margin, round(ratio, 6) AS ratio, round(logistic, 6) AS logistic, round(p_title - coalesce(p_title2, 0e0), 6) AS d_title, round(p_surface - coalesce(p_surface2, 0e0), 6) AS d_surface, round(CASE WHEN p_title2 IS NULL THEN 1e0 ELSE p_title / nullif(p_title + p_title2, 0) END, 6) AS r_title, round(CASE WHEN p_surface2 IS NULL THEN 1e0 ELSE p_surface / nullif(p_surface + p_surface2, 0) END, 6) AS r_surface FROM (SELECT *, " + LINKER + " FROM (SELECT doc_id, pos, title, place, p_title, p_surface, p_title2, p_surface2, score, score2 FROM ranked WHERE place = 1) y) x",
    "R7_surface_properties": "SELECT p.doc_id, p.pos, CASE WHEN p.cap THEN f.ambiguity ELSE 0 END AS ambiguity, CASE WHEN p.cap THEN round(f.linkability, 9) ELSE 0e0 END AS linkability, CASE WHEN p.cap AND f.total_count > 10 THEN round(f.linkability, 9) ELSE 0e0 END AS over10, CASE WHEN p.cap AND f.total_count > 50 THEN round(f.linkability, 9) ELSE 0e0 END AS over50, CASE WHEN p.cap AND f.total_count > 100 THEN round(f.linkability, 9) ELSE 0e0 END AS over100, p.cap AND coalesce(u.sure, FALSE) AS unambiguous, p.cap AS capitalised, CASE WHEN p.cap AND f.linked_count > 5 THEN round(CAST(f.singletons AS DOUBLE) / f.linked_count, 9) ELSE 0e0 END AS unseen_mass FROM placed p JOIN surface_forms f ON f.surface = p.surface LEFT JOIN (SELECT surface, max(p_title) >= 0.99 AS sure FROM surface_candidates GROUP BY surface) u ON u.surface = p.surface",
    "R8_linked": "SELECT doc_id, pos, title AS top, decision, CASE WHEN decision > 0 THEN title END AS link FROM (SELECT doc_id, pos, title, round(score + 0.5e0 * (score - coalesce(score2, 0e0)) + 2e0 * linkability - 2e0, 6) AS decision FROM ranked WHERE place = 1) x",
    "R9_levels": "SELECT doc_id, pos, level, title, linked FROM (SELECT doc_id, pos, CAST(0 AS BIGINT) AS level, title, score > 1.5 AS linked FROM ranked WHERE place = 1 UNION ALL SELECT doc_id, pos, CAST(1 AS BIGINT), title, next_score > 1.5 FROM (SELECT doc_id, pos, title, next_score, row_number() OVER (PARTITION BY doc_id, pos ORDER BY next_score DESC, rank) AS place FROM (SELECT doc_id, pos, title, rank, round(score + CASE WHEN place = 1 THEN 0.25e0 ELSE 0e0 END, 6) AS next_score FROM ranked) a) b WHERE place = 1) x",
    # Relations.
    "N1_merged_candidates": "SELECT doc_id, pos, title, round(exp(score) / sum(exp(score)) OVER (PARTITION BY doc_id, pos), 6) AS share FROM (SELECT doc_id, pos, title, score, row_number() OVER (PARTITION BY doc_id, pos, title ORDER BY level DESC) AS k FROM (SELECT doc_id, pos, title, 0 AS level, score FROM scored UNION ALL SELECT doc_id, pos, title, 1, round(score + CASE WHEN place = 1 THEN 0.25e0 ELSE 0e0 END, 6) FROM ranked) x) y WHERE k = 1",
    "N2_found_titles": f"SELECT n.doc_id, n.s, n.name, min(r.title) AS title, 1e0 AS linker_score FROM named n LEFT ANTI JOIN linked_counts l ON l.surface = n.low JOIN raw_titles r ON lower(substr(r.title, 1, 3)) = substr(n.low, 1, 3) WHERE {EDIT.format('n.low', 'lower(r.title)')} >= 0.8 AND NOT r.title LIKE '%(disambiguation)' GROUP BY n.doc_id, n.s, n.name HAVING count(*) = 1",
    "N3_long_names": "SELECT n.doc_id, n.s, n.e, l.pos AS left_pos, max(r.pos) AS right_pos FROM named n JOIN mentions l ON l.doc_id = n.doc_id AND l.pos = n.s JOIN mentions r ON r.doc_id = n.doc_id AND r.pos = n.e - 1 WHERE n.label <> 'PER' AND n.e - n.s >= 2 GROUP BY n.doc_id, n.s, n.e, l.pos",
    "N4_routed_names": "SELECT n.doc_id, n.s, CASE WHEN n.top IS NULL AND NOT n.name LIKE '%,%' AND NOT n.low LIKE '% and %' THEN 'title search' WHEN n.top IS NOT NULL AND n.name LIKE '%,%' THEN 'coref' WHEN n.top IS NOT NULL AND lower(n.last) = lower(n.top) THEN 'head coref' ELSE 'relation' END AS route, CASE WHEN n.low LIKE '% and %' THEN 0.5e0 ELSE 1e0 END AS scale FROM names n WHERE n.e - n.s >= 2",
    "N5_unique_titles": "SELECT low, title FROM (SELECT n.low, max(r.title) AS title, count(DISTINCT r.title) AS n FROM (SELECT DISTINCT low FROM named) n JOIN raw_titles r ON lower(r.title) = n.low GROUP BY n.low) x WHERE n = 1",
    "N6_location_expressions": "SELECT doc_id, pos, tok || ' ' || after AS expression FROM placed WHERE cap AND tok LIKE '%,' AND substr(after, 1, 1) <> lower(substr(after, 1, 1))",
    "N7_relations": f"SELECT doc_id, left_pos, right_pos, t1, t2, hits, CASE WHEN n = 1 THEN 100e0 WHEN place1 = 1 AND place2 = 1 THEN 100e0 ELSE round(exp(0.2e0 * hits) / total, 6) END AS weight FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, left_pos) AS n, sum(exp(0.2e0 * hits)) OVER (PARTITION BY doc_id, left_pos) AS total, max(CASE WHEN place1 = 1 AND place2 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, left_pos) AS exact FROM ({RELATIONS}) r WHERE place1 = 1 OR place2 = 1) x WHERE exact = 0 OR (place1 = 1 AND place2 = 1)",
    "N8_located": f"SELECT r.doc_id, r.left_pos, r.t1, r.t2, 1e0 AS weight FROM ({RELATIONS}) r JOIN placed p ON p.doc_id = r.doc_id AND p.pos = r.left_pos WHERE p.tok LIKE '%,' OR lower(r.t1) = lower(r.t2)",
    "N9_copied_candidates": "SELECT child.doc_id, child.pos AS child, parent.pos AS parent, child.title, 10e0 AS weight FROM ranked child JOIN (SELECT p.doc_id, p.pos, p.surface, p.title, lead(p.pos) OVER (PARTITION BY p.doc_id, p.surface, p.title ORDER BY p.pos) AS next_pos FROM ranked p) parent ON parent.doc_id = child.doc_id AND parent.next_pos = child.pos AND parent.title = child.title",
    "N10_contained_mentions": dual("SELECT p.doc_id, p.s, p.e, p.pos, m.surface FROM (SELECT doc_id, s, e, SEQ{s; e - 1} AS pos FROM chunks WHERE e - s > 1) p JOIN mentions m ON m.doc_id = p.doc_id AND m.pos = p.pos"),
    "N11_abbreviated": "SELECT DISTINCT a.doc_id, a.tok AS abbreviated, b.tok AS head FROM (SELECT DISTINCT doc_id, tok FROM tokens WHERE length(tok) < 5 AND tok LIKE '%.') a JOIN (SELECT DISTINCT doc_id, tok FROM tokens WHERE length(tok) < 4) b ON a.doc_id = b.doc_id AND a.tok = b.tok || '.' JOIN linked_counts l ON l.surface = lower(b.tok)",
    "N12_appositions": "SELECT n.doc_id, n.s, p.pos AS noun_pos, p.tok AS noun FROM named n JOIN placed p ON p.doc_id = n.doc_id AND p.pos = n.e WHERE n.label = 'PER' AND NOT p.cap AND NOT p.starts AND (p.surface LIKE '%or' OR p.surface LIKE '%er' OR p.surface LIKE '%ier')",
    "N13_weights": " UNION ALL ".join(f"SELECT '{k}' AS kind, {v}e0 AS weight" for k, v in WEIGHTS.items()),
    "N15_applied": f"SELECT r.doc_id, r.pos, r.title AS prior, CASE WHEN r.linkability < 0.05 THEN NULL WHEN a.t1 IS NOT NULL THEN a.t1 ELSE r.title END AS final, CASE WHEN a.t1 IS NOT NULL THEN 1e0 ELSE round(r.score - 1.5e0, 6) + 0e0 END AS linker_score FROM ranked r LEFT JOIN (SELECT doc_id, left_pos, max(t1) AS t1 FROM ({RELATIONS}) q WHERE hits = 2 GROUP BY doc_id, left_pos) a ON a.doc_id = r.doc_id AND a.left_pos = r.pos WHERE r.place = 1",
    "N17_explained": f"SELECT CASE WHEN place1 = 1 AND place2 = 1 THEN 'accepted' ELSE 'discarded' END AS verdict, hits, count(*) AS n FROM ({RELATIONS}) r GROUP BY 1, 2",
    # Coreference.
    "Q1_cluster_order": "SELECT doc_id, s, low, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY e - s, length(low), s) AS BIGINT) AS turn FROM named WHERE NOT (label = 'LOC' AND e - s > 1)",
    "Q2_clusters": "SELECT q.doc_id, q.low, q.label, count(*) AS n, min(q.s) AS first FROM (SELECT n.doc_id, n.low, n.label, n.s, count(*) OVER (PARTITION BY n.doc_id, n.head) AS n_same_head FROM named n) q JOIN (SELECT doc_id, head, count(DISTINCT low) AS ambiguity FROM named GROUP BY doc_id, head) a ON a.doc_id = q.doc_id WHERE lower(a.head) = q.low AND a.ambiguity <= 2 GROUP BY q.doc_id, q.low, q.label HAVING count(*) > 1",
    "Q3_ambiguity": "SELECT doc_id, label, low, count(DISTINCT coalesce(top, low)) AS ambiguity, count(*) AS n FROM names GROUP BY doc_id, label, low",
    "Q4_not_corefable": "SELECT doc_id, low, max(CASE WHEN label <> 'LOC' THEN 1 ELSE 0 END) = 0 OR max(CASE WHEN label = 'MISC' AND (low LIKE '%an' OR low LIKE '%ish') THEN 1 ELSE 0 END) = 1 AS not_corefable FROM named GROUP BY doc_id, low",
    "Q6_election": """SELECT doc_id, head, title AS elected FROM (SELECT doc_id, head, title, row_number() OVER (PARTITION BY doc_id, head ORDER BY votes DESC, title) AS k FROM (SELECT v.doc_id, v.head, v.title, round(sum(v.vote), 6) AS votes FROM (SELECT n.doc_id, lower(n.head) AS head, coalesce(n.top, '*null*') AS title, coalesce(n.score, 1e0) AS vote FROM names n WHERE n.e - n.s > 1
        UNION ALL SELECT n.doc_id, n.low, n.top, 1e0 FROM names n LEFT SEMI JOIN (SELECT doc_id, lower(head) AS head, top FROM names WHERE e - s > 1) p ON p.doc_id = n.doc_id AND p.head = n.low AND p.top = n.top WHERE n.e - n.s = 1) v GROUP BY v.doc_id, v.head, v.title) w) x WHERE k = 1""",
    "Q7_heads": dual("SELECT c.doc_id, c.s AS child, h.s AS head, c.low FROM names c JOIN (SELECT doc_id, low, LEAST_OF{s; -coalesce(score, 0e0), s} AS s FROM names GROUP BY doc_id, low) h ON h.doc_id = c.doc_id AND h.low = c.low WHERE c.s <> h.s AND c.e - c.s <= 2"),
    "Q8_exceptions": "SELECT a.doc_id, a.low, a.label FROM (SELECT DISTINCT doc_id, low, label FROM named) a LEFT ANTI JOIN (SELECT doc_id, low FROM named GROUP BY doc_id, low HAVING count(DISTINCT label) > 1 OR max(e - s) > 3) x ON x.doc_id = a.doc_id AND x.low = a.low",
    "Q9_index_variants": "SELECT v.variant, n.doc_id, count(*) AS n FROM named n JOIN (SELECT 'NER' AS variant, 1 AS least UNION ALL SELECT 'TOPLEVEL', 2) v ON n.e - n.s >= v.least GROUP BY v.variant, n.doc_id",
    "Q10_best_antecedent": "SELECT doc_id, s, low, coalesce(lag(s) OVER (PARTITION BY doc_id, low ORDER BY s), -1) AS antecedent, lag(label) OVER (PARTITION BY doc_id, low ORDER BY s) AS antecedent_label FROM named",
    "Q11_best_links": "SELECT doc_id, s, antecedent, score FROM (SELECT doc_id, s, antecedent, round(16e0 - 0.5e0 * (s - antecedent) / 8, 4) AS score FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id, low ORDER BY s) AS antecedent FROM named) x WHERE antecedent IS NOT NULL) y WHERE score > 0 AND s - antecedent <= 50",
    "Q12_constraints": "SELECT doc_id, s, antecedent, low = before_low AS equal_names, label = before_label AS same_label, CAST(length(low) - length(before_low) AS BIGINT) AS longer FROM (SELECT doc_id, s, low, label, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS antecedent, lag(low) OVER (PARTITION BY doc_id ORDER BY s) AS before_low, lag(label) OVER (PARTITION BY doc_id ORDER BY s) AS before_label FROM named) x WHERE antecedent IS NOT NULL",
    "Q13_mention_view": "SELECT doc_id, label, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS n_tokens FROM named GROUP BY doc_id, label",
    # Evaluation.
    "E1_outcomes_at_k": OUTCOMES,
    "E2_scores_at_k": f"SELECT k, {RATE.format('tp', 'tp + fp + mismatch')} AS precision_, {RATE.format('tp', 'tp + fn + mismatch')} AS recall_, {RATE.format('tp + tn', 'tp + fp + tn + fn + mismatch')} AS accuracy, round(2e0 * tp / nullif(2 * tp + fp + fn + 2 * mismatch, 0), 6) AS f1 FROM ({OUTCOMES}) o",
    "E3_bag_of_concepts": """SELECT p.doc_id, p.predicted, coalesce(g.expected, 0) AS expected, p.correct, p.wrong_on_all_text FROM (SELECT p.doc_id, count(*) AS predicted, count(g.t) AS correct, CAST(sum(CASE WHEN g.t IS NULL AND p.on_gold = 1 THEN 1 ELSE 0 END) AS BIGINT) AS wrong_on_all_text
        FROM (SELECT x.doc_id, x.link AS t, max(CASE WHEN s.surface IS NOT NULL THEN 1 ELSE 0 END) AS on_gold FROM decided x LEFT JOIN (SELECT DISTINCT m.doc_id, m.surface FROM gold g JOIN mentions m ON m.doc_id = g.doc_id AND m.pos = g.pos WHERE g.gold IS NOT NULL) s ON s.doc_id = x.doc_id AND s.surface = x.surface WHERE x.link IS NOT NULL GROUP BY x.doc_id, x.link) p
        LEFT JOIN (SELECT DISTINCT doc_id, gold AS t FROM gold WHERE gold IS NOT NULL) g ON g.doc_id = p.doc_id AND g.t = p.t GROUP BY p.doc_id) p LEFT JOIN (SELECT doc_id, count(DISTINCT gold) AS expected FROM gold WHERE gold IS NOT NULL GROUP BY doc_id) g ON g.doc_id = p.doc_id""",
    "E4_concept_scores": f"SELECT {RATE.format('correct', 'predicted')} AS precision_, {RATE.format('correct', 'expected')} AS recall_, round(2e0 * correct / nullif(predicted + expected, 0), 6) AS f1 FROM (SELECT count(p.t) AS predicted, count(g.t) AS expected, sum(CASE WHEN p.t = g.t THEN 1 ELSE 0 END) AS correct FROM (SELECT DISTINCT doc_id, link AS t FROM decided WHERE link IS NOT NULL) p FULL OUTER JOIN (SELECT DISTINCT doc_id, gold AS t FROM gold WHERE gold IS NOT NULL) g ON p.doc_id = g.doc_id AND p.t = g.t) s",
    "E5_linker_accuracy": f"SELECT solvable, {RATE.format('forced', 'solvable')} AS forced_accuracy, {RATE.format('correct', 'n')} AS linker_accuracy, {RATE.format('everything', 'n')} AS link_everything FROM (SELECT count(*) AS n, CAST(sum(CASE WHEN c.rank IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS solvable, sum(CASE WHEN c.rank IS NOT NULL AND x.top = g.gold THEN 1 ELSE 0 END) AS forced, sum(CASE WHEN coalesce(x.link, '*null*') = coalesce(g.gold, '*null*') OR (x.link IS NULL AND c.rank IS NULL) THEN 1 ELSE 0 END) AS correct, sum(CASE WHEN x.top = g.gold THEN 1 ELSE 0 END) AS everything FROM decided x JOIN gold g ON g.doc_id = x.doc_id AND g.pos = x.pos LEFT JOIN candidates c ON c.doc_id = g.doc_id AND c.pos = g.pos AND c.title = g.gold) s",
    "E6_predictions": "SELECT CAST(sum(CASE WHEN p.link = g.gold THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN p.link IS NOT NULL AND coalesce(g.gold, '*null*') <> p.link THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN p.link IS NULL AND g.gold IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN p.link IS NULL AND g.gold IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM gold g LEFT JOIN (SELECT doc_id, pos, link FROM decided) p ON p.doc_id = g.doc_id AND p.pos = g.pos",
    "E7_transitions": "SELECT CASE WHEN right0 AND NOT right1 THEN 'broken' WHEN NOT right0 AND right1 THEN 'fixed' WHEN right0 THEN 'kept right' ELSE 'kept wrong' END AS change, count(*) AS n FROM (SELECT r.doc_id, r.pos, coalesce(max(CASE WHEN r.rank = 1 THEN r.title END) = max(g.gold), FALSE) AS right0, coalesce(max(CASE WHEN r.place = 1 THEN r.title END) = max(g.gold), FALSE) AS right1 FROM ranked r JOIN gold g ON g.doc_id = r.doc_id AND g.pos = r.pos GROUP BY r.doc_id, r.pos) x GROUP BY 1",
    "E9_set_scores": f"SELECT n_both, {RATE.format('n_both', 'n_found')} AS precision_, {RATE.format('n_both', 'n_known')} AS recall_, round(2e0 * n_both / nullif(n_found + n_known, 0), 6) AS f1 FROM (SELECT count(a.surface) AS n_found, count(b.surface) AS n_known, CAST(sum(CASE WHEN a.surface = b.surface THEN 1 ELSE 0 END) AS BIGINT) AS n_both FROM (SELECT DISTINCT surface FROM token_surfaces) a FULL OUTER JOIN (SELECT DISTINCT surface FROM anchor_surfaces) b ON a.surface = b.surface) x",
    "E11_log_errors": "SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN event_type = 'error' AND before = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS in_a_row, max(CASE WHEN event_type = 'error' THEN before END) AS last_before FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) x GROUP BY user_id",
    "E12_external_concepts": dual("WITH lines AS (SELECT doc_id, JOINED{link || '|' || surface; '\t'; pos} AS line FROM decided WHERE link IS NOT NULL GROUP BY doc_id), parsed AS (SELECT DISTINCT doc_id, GET{SPLIT{part; '[|]'}; 1} AS t FROM (SELECT doc_id, PARTS{line; '\t'} AS part FROM lines) x) SELECT p.doc_id, count(*) AS predicted, count(g.t) AS correct FROM parsed p LEFT JOIN (SELECT DISTINCT doc_id, gold AS t FROM gold WHERE gold IS NOT NULL) g ON g.doc_id = p.doc_id AND g.t = p.t GROUP BY p.doc_id"),
    # Training samples and corpus statistics.
    "W1_ranker_samples": "SELECT c.doc_id, c.pos, c.title, CASE WHEN f.flip THEN -1 ELSE 1 END AS label, round(CASE WHEN f.flip THEN c.p_title - g.p_title ELSE g.p_title - c.p_title END, 9) + 0e0 AS d_title, round(CASE WHEN f.flip THEN c.p_surface - g.p_surface ELSE g.p_surface - c.p_surface END, 9) + 0e0 AS d_surface FROM candidates c JOIN (SELECT x.doc_id, x.pos, x.title, x.p_title, x.p_surface FROM candidates x JOIN gold y ON x.doc_id = y.doc_id AND x.pos = y.pos AND x.title = y.gold) g ON c.doc_id = g.doc_id AND c.pos = g.pos AND c.title <> g.title JOIN (SELECT doc_id, pos, substr(md5(CAST(doc_id AS VARCHAR(20)) || '_' || CAST(pos AS VARCHAR(20))), 1, 1) < '8' AS flip FROM mentions) f ON f.doc_id = c.doc_id AND f.pos = c.pos",
    "Z5_words_by_class": "SELECT source, token, tf, CAST(k AS BIGINT) AS k FROM (SELECT title AS source, token, tf, row_number() OVER (PARTITION BY title ORDER BY tf DESC, token) AS k FROM source_counts) x WHERE k <= 50",
    "Z7_orders": "SELECT doc_id, s, e, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s) AS BIGINT) AS longest, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY e - s, s) AS BIGINT) AS shortest, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, e) AS BIGINT) AS earliest, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC NULLS LAST, s) AS BIGINT) AS by_score FROM names",
    "Z10_zipped": "SELECT a.doc_id, a.pos, a.tok AS left_tok, b.tok AS right_tok FROM (SELECT doc_id, pos, tok FROM tokens) a JOIN (SELECT doc_id, pos - 1 AS pos, tok FROM tokens) b ON b.doc_id = a.doc_id AND b.pos = a.pos",
    # Lexicon paths; customers, nations and regions stand for a hierarchy of senses.
    "H1_related_words": "SELECT child AS word, 'hypernym' AS relation, parent AS other FROM lex_nodes UNION ALL SELECT parent, 'hyponym', child FROM lex_nodes UNION ALL SELECT a.child, 'sister', min(b.child) FROM lex_nodes a JOIN lex_nodes b ON b.parent = a.parent AND b.child <> a.child WHERE a.child LIKE 'n%' GROUP BY a.child",
    "H2_hypernym_chains": dual("SELECT word, JOINED{up; ' > '; depth} AS chain, max(depth) AS depth FROM lex_up GROUP BY word"),
    "H3_similarity": "SELECT word1, word2, len, CASE WHEN len <= 3 THEN round(power(0.3e0, len), 6) WHEN depth >= 1.5 * len THEN round(power(0.3e0, 3), 6) ELSE 0e0 END AS similarity FROM (SELECT a.word AS word1, b.word AS word2, min(a.depth + b.depth) AS len, max(3 - a.depth) AS depth FROM lex_up a JOIN lex_up b ON b.up = a.up AND a.word < b.word WHERE a.word LIKE 'n%' AND b.word LIKE 'n%' GROUP BY a.word, b.word) x",
    "H4_restricted_similarity": "SELECT w.word, u.up, round(power(0.3e0, u.depth) / w.n_senses, 6) AS similarity FROM (SELECT word, CAST(count(*) AS DOUBLE) AS n_senses FROM lex_up GROUP BY word) w JOIN lex_up u ON u.word = w.word WHERE u.depth BETWEEN 1 AND 2 AND u.up LIKE 'r%'",
    "H5_synsets": dual("SELECT p_type AS synset, JOINED{word; ' '; word} AS words FROM (SELECT DISTINCT p_type, GSUB{GET{SPLIT{p_name; ' '}; 2}; '(s|er|ing)$'; ''} AS word FROM part) x GROUP BY p_type"),
    "H6_noun_forms": dual("SELECT DISTINCT surface, GSUB{surface; '(ian|ish|ese|ic)$'; ''} AS noun, surface <> GSUB{surface; '(ian|ish|ese|ic)$'; ''} AS is_adjective FROM token_surfaces"),
    "H7_person_nouns": "SELECT surface, surface LIKE '%or' OR surface LIKE '%er' AS is_person, count(*) AS n FROM token_surfaces GROUP BY surface",
    # What a service gives back.
    "A6_service_labels": "SELECT p.doc_id, p.pos, p.tok, CASE WHEN x.top IS NULL THEN 'UNMAPPED' ELSE x.top END AS label, x.link IS NOT NULL AND x.linkability > 0.05 AS is_linked FROM placed p LEFT JOIN (SELECT d.doc_id, d.pos, d.top, d.link, b.linkability FROM decided d JOIN best b ON b.doc_id = d.doc_id AND b.pos = d.pos) x ON x.doc_id = p.doc_id AND x.pos = p.pos WHERE x.top IS NOT NULL OR (NOT p.cap AND length(p.tok) > 3)",
}
