"""Further model tables: places of tokens, named spans, title links, contexts and scores of candidates."""

from __future__ import annotations

import re

from .dialect import dual

CAP = "substr({0}, 1, 1) <> lower(substr({0}, 1, 1))"


def cap(x: str) -> str:
    return f"({CAP.format(x)})"


#: Titles link like parts do: the same tables over another graph.
GRAPH = ("links", "out_sizes", "in_sizes", "linked_pairs", "titles_n", "in_shared", "out_shared", "pairwise_sim")


def over_titles(text: str) -> str:
    return re.sub(r"\b(" + "|".join(GRAPH) + r")\b", r"t_\1", text)


WINDOWS = (20, 50, 100, 150, 200)
COSINES = ", ".join(f"round(coalesce(sum(c.c{w} * c.idf * t.w) / nullif(max(c.n{w}) * max(t.len), 0), 0), 6) + 0e0 AS win{i}" for i, w in enumerate(WINDOWS))
SCORE = "round(2.0e0 * p_title + 0.5e0 * p_surface - 0.01e0 * rank, 6)"

TABLES = {
    # Places in the text with single spaces; a sentence ends with a stop.
    "placed": dual(
        f"""SELECT doc_id, pos, tok, surface, cs, CAST(length(tok) AS BIGINT) AS cl, {cap("tok")} AS cap, coalesce({cap("before")}, FALSE) AS cap_before, before, before2, after,
        before IS NULL OR before LIKE '%.' OR before LIKE '%!' OR before LIKE '%?' AS starts, tok LIKE '%.' OR tok LIKE '%!' OR tok LIKE '%?' AS ends FROM (SELECT doc_id, pos, tok, surface,
        CAST(sum(length(tok) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) - length(tok) - 1 AS cs, lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS before,
        lag(tok, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS before2, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM token_surfaces) x"""
    ),
    # A named span is a run of capitalised words of one sentence; its label stands for that of an external annotator.
    "tagged": "SELECT doc_id, pos, tok, surface, cs, cl, CASE WHEN NOT cap THEN 'O' WHEN cap_before AND NOT starts THEN 'I' ELSE 'B' END AS tag FROM placed",
    "named": dual(
        """SELECT doc_id, s, e, cs, ce, name, head, last, lower(name) AS low, CASE WHEN k < '4' THEN 'PER' WHEN k < '8' THEN 'LOC' WHEN k < 'c' THEN 'ORG' ELSE 'MISC' END AS label FROM (
        SELECT doc_id, min(pos) AS s, max(pos) + 1 AS e, min(cs) AS cs, max(cs + cl) AS ce, JOINED{tok; ' '; pos} AS name, min_by(tok, pos) AS head, max_by(tok, pos) AS last, substr(md5(lower(min_by(surface, pos))), 1, 1) AS k
        FROM (SELECT doc_id, pos, tok, surface, cs, cl, tag, sum(CASE WHEN tag = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM tagged) x WHERE tag <> 'O' GROUP BY doc_id, run) y"""
    ),
    "stops": "SELECT token FROM vocab CROSS JOIN n_docs WHERE df * 2 > n_docs.n",
    "raw_titles": "SELECT title, count(*) AS n FROM anchors GROUP BY title",
    "variants": "SELECT c.title AS src, t.title AS dst FROM surface_candidates c JOIN surface_candidates t ON c.surface = t.surface AND t.rank = 1 WHERE c.rank > 1",
    "t_links": "SELECT DISTINCT a.title AS src, b.title AS dst FROM anchors a JOIN anchors b ON a.page_id = b.page_id AND a.title <> b.title AND length(a.title) >= length(b.title)",
    # Texts of titles: the surfaces beside them on their pages.
    "title_text": "SELECT a.title, b.surface AS token, count(*) AS tf FROM anchor_surfaces a JOIN anchor_surfaces b ON a.page_id = b.page_id AND a.title <> b.title GROUP BY a.title, b.surface",
    "title_w": "SELECT x.title, x.token, x.tf * ln((CAST(d.n AS DOUBLE) + 1) / v.df) AS w FROM title_text x JOIN vocab v ON v.token = x.token CROSS JOIN n_docs d",
    "title_lens": "SELECT title, token, w, sqrt(sum(w * w) OVER (PARTITION BY title)) AS len FROM title_w",
    # Within a surface's candidates, words that all of them have weigh little.
    "title_rw": """SELECT surface, title, token, w, sqrt(sum(w * w) OVER (PARTITION BY surface, title)) AS len FROM (SELECT x.surface, x.title, x.token, x.w * ln(d.total / x.of_token) AS w
        FROM (SELECT c.surface, c.title, t.token, t.w, sum(t.w) OVER (PARTITION BY c.surface, t.token) AS of_token FROM surface_candidates c JOIN title_w t ON t.title = c.title WHERE c.rank <= 20) x
        JOIN (SELECT surface, sum(m) AS total FROM (SELECT c.surface, c.title, max(t.w) AS m FROM surface_candidates c JOIN title_w t ON t.title = c.title WHERE c.rank <= 20 GROUP BY c.surface, c.title) y GROUP BY surface) d ON d.surface = x.surface) z""",
    "idf": "SELECT token, ln((CAST(d.n AS DOUBLE) + 1) / v.df) AS idf FROM vocab v CROSS JOIN n_docs d",
    "mention_places": "SELECT p.doc_id, p.pos, p.cs, p.cl, p.surface FROM placed p JOIN linked_counts l ON l.surface = p.surface",
    # Words around a mention by distance in characters: an equi-join on stretches of the text, linear in its length.
    "around": dual(
        "SELECT m.doc_id, m.pos, m.surface AS of_surface, t.token, "
        + ", ".join(f"CAST(sum(CASE WHEN t.cs >= m.cs - {w} AND t.cs + t.cl <= m.cs + m.cl + {w} THEN 1 ELSE 0 END) AS BIGINT) AS c{w}" for w in WINDOWS)
        + " FROM (SELECT doc_id, pos, cs, cl, surface, SEQ{CAST(floor((cs - 200) / 256.0) AS BIGINT); CAST(floor((cs + cl + 200) / 256.0) AS BIGINT)} AS stretch FROM mention_places) m"
        " JOIN (SELECT doc_id, pos, cs, cl, surface AS token, CAST(floor(cs / 256.0) AS BIGINT) AS stretch FROM placed WHERE surface <> '') t ON t.doc_id = m.doc_id AND t.stretch = m.stretch AND t.pos <> m.pos"
        " WHERE t.cs >= m.cs - 200 AND t.cs + t.cl <= m.cs + m.cl + 200 GROUP BY m.doc_id, m.pos, m.surface, t.token"
    ),
    "contexts": "SELECT a.*, i.idf FROM around a JOIN idf i ON i.token = a.token",
    "context_lens": "SELECT doc_id, pos, " + ", ".join(f"sqrt(sum(c{w} * idf * c{w} * idf)) AS n{w}" for w in WINDOWS) + " FROM contexts GROUP BY doc_id, pos",
    "scored": f"SELECT doc_id, pos, surface, title, rank, p_title, p_surface, linkability, {SCORE} AS score FROM candidates",
    "ranked": "SELECT doc_id, pos, surface, title, rank, p_title, p_surface, linkability, score, CAST(row_number() OVER (PARTITION BY doc_id, pos ORDER BY score DESC, rank) AS BIGINT) AS place, lead(title) OVER (PARTITION BY doc_id, pos ORDER BY score DESC, rank) AS second, lead(score) OVER (PARTITION BY doc_id, pos ORDER BY score DESC, rank) AS score2, lead(p_title) OVER (PARTITION BY doc_id, pos ORDER BY score DESC, rank) AS p_title2, lead(p_surface) OVER (PARTITION BY doc_id, pos ORDER BY score DESC, rank) AS p_surface2, lead(rank) OVER (PARTITION BY doc_id, pos ORDER BY score DESC, rank) AS rank2 FROM scored",
    # Names of a document with their first title.
    "names": "SELECT n.doc_id, n.s, n.e, n.cs, n.name, n.low, n.label, n.head, n.last, b.title AS top, b.score FROM named n LEFT JOIN (SELECT doc_id, pos, title, score FROM ranked WHERE place = 1) b ON b.doc_id = n.doc_id AND b.pos = n.s",
    "lex_nodes": "SELECT 'c' || CAST(c_custkey AS VARCHAR(20)) AS child, 'n' || CAST(c_nationkey AS VARCHAR(20)) AS parent FROM customer UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR(20)), 'r' || CAST(n_regionkey AS VARCHAR(20)) FROM nation UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR(20)), 'root' FROM region",
    "lex_up": "SELECT child AS word, child AS up, CAST(0 AS BIGINT) AS depth FROM lex_nodes UNION ALL SELECT child, parent, CAST(1 AS BIGINT) FROM lex_nodes UNION ALL SELECT a.child, b.parent, CAST(2 AS BIGINT) FROM lex_nodes a JOIN lex_nodes b ON b.child = a.parent UNION ALL SELECT a.child, c.parent, CAST(3 AS BIGINT) FROM lex_nodes a JOIN lex_nodes b ON b.child = a.parent JOIN lex_nodes c ON c.child = b.parent",
}


def with_titles(base: dict) -> dict:
    """All of these and the link tables once more, over titles."""
    graph = {"t_" + n: over_titles(base[n]) for n in GRAPH if n != "links"}
    return base | TABLES | graph
