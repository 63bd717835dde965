"""The model tables of the entity-linking engine as common table expressions.

Each table is SQL over the input tables and other model tables. Where Spark and
the oracle's dialect differ, an entry holds both texts; else one serves both.
A query takes only the tables that it needs, so Catalyst sees one plan from the
scans to the result and prunes columns and pushes filters through all of it.
"""

from __future__ import annotations

import re

from . import spark_forms, tables_link

TABLES: dict[str, str | tuple[str, str]] = {
    # Links of pages: the anchor text is the title.
    "anchors": (
        """SELECT page_id, explode(regexp_extract_all(html, '<a href="/([^"]*)">', 1)) AS title FROM pages""",
        """SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)">', 1)) AS title FROM pages""",
    ),
    "anchor_surfaces": "SELECT page_id, title, lower(replace(replace(title, '.', ''), ',', '')) AS surface FROM anchors",
    "tokens": (
        "SELECT doc_id, CAST(pos AS BIGINT) AS pos, tok FROM (SELECT doc_id, posexplode(split(text, '[ \n]+')) AS (pos, tok) FROM documents) WHERE tok <> ''",
        "SELECT doc_id, pos, tok FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS tok FROM (SELECT doc_id, string_split_regex(text, '[ \n]+') AS l FROM documents)) WHERE tok <> ''",
    ),
    "token_surfaces": "SELECT doc_id, pos, tok, lower(replace(replace(tok, '.', ''), ',', '')) AS surface FROM tokens",
    "pair_counts": "SELECT surface, title, count(*) AS n FROM anchor_surfaces GROUP BY surface, title",
    "surface_candidates": """SELECT surface, title, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY surface) AS p_title, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY title) AS p_surface,
        CAST(row_number() OVER (PARTITION BY surface ORDER BY n DESC, title) AS BIGINT) AS rank FROM pair_counts""",
    "linked_counts": "SELECT surface, CAST(sum(n) AS BIGINT) AS linked_count, count(*) AS ambiguity, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons FROM pair_counts GROUP BY surface",
    # Only known surfaces are counted in documents: the filter comes before the shuffle.
    "seen_counts": "SELECT surface, count(*) AS seen FROM token_surfaces WHERE surface IN (SELECT surface FROM linked_counts) GROUP BY surface",
    "surface_forms": """SELECT l.surface, l.linked_count, l.ambiguity, l.singletons, l.linked_count + coalesce(s.seen, 0) AS total_count,
        CAST(l.linked_count AS DOUBLE) / (l.linked_count + coalesce(s.seen, 0)) AS linkability FROM linked_counts l LEFT JOIN seen_counts s ON l.surface = s.surface""",
    "mentions": "SELECT t.doc_id, t.pos, t.tok, t.surface, f.linkability, f.ambiguity, f.singletons, f.linked_count, f.total_count FROM token_surfaces t JOIN surface_forms f ON t.surface = f.surface",
    # Runs of mentions side by side.
    "chunks": "SELECT doc_id, min(pos) AS s, max(pos) + 1 AS e FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM mentions) x GROUP BY doc_id, run",
    "gold": "SELECT m.doc_id, m.pos, t.title AS gold FROM mentions m LEFT JOIN (SELECT DISTINCT title FROM anchors) t ON m.tok = t.title",
    "candidates": "SELECT m.doc_id, m.pos, m.surface, m.linkability, c.title, c.p_title, c.p_surface, c.n, c.rank FROM mentions m JOIN surface_candidates c ON m.surface = c.surface WHERE c.rank <= 20",
    "best": "SELECT m.doc_id, m.pos, m.tok, m.surface, m.linkability, c.title AS top, c.p_title FROM mentions m JOIN surface_candidates c ON m.surface = c.surface WHERE c.rank = 1",
    "decided": "SELECT doc_id, pos, tok, surface, top, p_title, CASE WHEN linkability >= 0.05 AND length(surface) >= 2 THEN top END AS link FROM best",
    "links": """SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) x
        WHERE dst IS NOT NULL AND src <> dst""",
    "out_sizes": "SELECT src AS id, count(*) AS n FROM links GROUP BY src",
    "in_sizes": "SELECT dst AS id, count(*) AS n FROM links GROUP BY dst",
    "linked_pairs": "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM links",
    "titles_n": "SELECT count(*) AS n FROM (SELECT src AS id FROM links UNION SELECT dst FROM links) u",
    # Shared neighbours of linked pairs only, never of all co-occurring ones.
    "in_shared": "SELECT p.a, p.b, count(*) AS i FROM linked_pairs p JOIN links x ON x.dst = p.a JOIN links y ON y.dst = p.b AND y.src = x.src GROUP BY p.a, p.b",
    "out_shared": "SELECT p.a, p.b, count(*) AS i FROM linked_pairs p JOIN links x ON x.src = p.a JOIN links y ON y.src = p.b AND y.dst = x.dst GROUP BY p.a, p.b",
    "pairwise_sim": """SELECT p.a, p.b, coalesce(1000.0 * i.i / (CAST(ia.n AS DOUBLE) * ib.n), 0) AS in_pmi, coalesce(1000.0 * o.i / (CAST(oa.n AS DOUBLE) * ob.n), 0) AS out_pmi,
        coalesce(1 - (ln(greatest(ia.n, ib.n)) - ln(i.i)) / (ln(t.n) - ln(least(ia.n, ib.n))), 0) AS in_ngd, coalesce(1 - (ln(greatest(oa.n, ob.n)) - ln(o.i)) / (ln(t.n) - ln(least(oa.n, ob.n))), 0) AS out_ngd,
        f.src IS NOT NULL AND g.src IS NOT NULL AS two_way
        FROM linked_pairs p CROSS JOIN titles_n t LEFT JOIN in_shared i ON i.a = p.a AND i.b = p.b LEFT JOIN out_shared o ON o.a = p.a AND o.b = p.b
        LEFT JOIN in_sizes ia ON ia.id = p.a LEFT JOIN in_sizes ib ON ib.id = p.b LEFT JOIN out_sizes oa ON oa.id = p.a LEFT JOIN out_sizes ob ON ob.id = p.b
        LEFT JOIN links f ON f.src = p.a AND f.dst = p.b LEFT JOIN links g ON g.src = p.b AND g.dst = p.a""",
    # Neighbours weigh by their specificity; a page that nothing links to weighs 0.01.
    "specificity": "SELECT u.id, coalesce(CAST(1 AS DOUBLE) / i.n, 0.01) AS w FROM (SELECT src AS id FROM links UNION SELECT dst FROM links) u LEFT JOIN in_sizes i ON i.id = u.id",
    "in_norms": "SELECT x.dst AS id, sqrt(sum(s.w * s.w)) AS n FROM links x JOIN specificity s ON s.id = x.src GROUP BY x.dst",
    "out_norms": "SELECT x.src AS id, sqrt(sum(s.w * s.w)) AS n FROM links x JOIN specificity s ON s.id = x.dst GROUP BY x.src",
    "in_dots": "SELECT p.a, p.b, sum(s.w * s.w) AS dot FROM linked_pairs p JOIN links x ON x.dst = p.a JOIN links y ON y.dst = p.b AND y.src = x.src JOIN specificity s ON s.id = x.src GROUP BY p.a, p.b",
    "out_dots": "SELECT p.a, p.b, sum(s.w * s.w) AS dot FROM linked_pairs p JOIN links x ON x.src = p.a JOIN links y ON y.src = p.b AND y.dst = x.dst JOIN specificity s ON s.id = x.dst GROUP BY p.a, p.b",
    "term_counts": "SELECT doc_id, surface AS token, count(*) AS tf FROM token_surfaces WHERE surface <> '' GROUP BY doc_id, surface",
    "vocab": "SELECT token, count(*) AS df FROM term_counts GROUP BY token",
    "n_docs": "SELECT count(*) AS n FROM documents",
    "doc_vectors": "SELECT t.doc_id, t.token, t.tf * ln(CAST(d.n AS DOUBLE) / v.df) AS w FROM term_counts t JOIN vocab v ON t.token = v.token CROSS JOIN n_docs d",
    "source_counts": "SELECT d.source AS title, t.token, CAST(sum(t.tf) AS BIGINT) AS tf FROM term_counts t JOIN documents d ON t.doc_id = d.doc_id GROUP BY d.source, t.token",
    "title_vectors": "SELECT s.title, s.token, s.tf * ln(CAST(d.n AS DOUBLE) / v.df) AS w FROM source_counts s JOIN vocab v ON s.token = v.token CROSS JOIN n_docs d",
    "triples": "SELECT l.l_partkey AS arg1, CASE WHEN l.l_returnflag = 'N' THEN 'LINK' ELSE l.l_returnflag END AS pred, l.l_suppkey AS arg2, count(*) AS score FROM lineitem l GROUP BY 1, 2, 3",
    "redirects": "SELECT 'n' || CAST(n_nationkey AS VARCHAR(10)) AS src, 'n' || CAST(n_nationkey - 1 AS VARCHAR(10)) AS dst FROM nation WHERE n_nationkey > 0",
    "turns": "SELECT conv_id, turn, role, text FROM conversations",
}

TABLES = tables_link.with_titles(TABLES)
SPARK_TABLES = {n: x if isinstance(x, str) else x[0] for n, x in TABLES.items()} | spark_forms.TABLES
ORACLE_TABLES = {n: x if isinstance(x, str) else x[1] for n, x in TABLES.items()}


def sql(query: str, spark: bool) -> str:
    """A query with the model tables that it needs, for Spark or for the oracle."""
    tables = SPARK_TABLES if spark else ORACLE_TABLES
    needed: list[str] = []

    def visit(q: str) -> None:
        for name in tables:
            if name not in needed and re.search(rf"\b{name}\b", q) and re.search(rf"(FROM|JOIN)\s+\(*{name}\b", q):
                visit(tables[name])
                needed.append(name)

    if not isinstance(query, str):
        query = query[0 if spark else 1]
    query = spark_forms.same_row(query) if spark else query
    visit(query)
    head = ", ".join(f"{n} AS ({tables[n]})" for n in needed)
    if not needed:
        return query
    recursive = query.lstrip().upper().startswith("WITH RECURSIVE")
    if recursive:
        return f"WITH RECURSIVE {head}, {query.lstrip()[len('WITH RECURSIVE') :]}"
    if query.lstrip().upper().startswith("WITH "):
        return f"WITH {head}, {query.lstrip()[len('WITH ') :]}"
    return f"WITH {head} {query}"
