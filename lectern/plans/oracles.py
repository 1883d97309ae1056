"""SQL for the queries, over the same tables."""

from __future__ import annotations

# Words that tell Spanish and English.
SPANISH = ("el ", "la ", "los ", "las ", "de ", "que ", "en ", "y ", "sea ", "para ", "por ", "como ", "con ", "se ")
ENGLISH = ("the ", "and ", "is ", "are ", "for ", "that ", "with ", "this ", "from ", "have ", "has ")

_TOK = r"list_filter(regexp_split_to_array(lower({}), '[\s\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda x: x <> '')"


def _tok(c: str) -> str:
    return _TOK.format(c)


_QUESTIONS = "questions AS (SELECT doc_id AS query_id, title AS query FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL)"
_LIBRARY = "library AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_key) AS nth FROM text_chunks WHERE chunk_id IS NOT NULL) WHERE nth = 1)"


def _bm25(docs: str, key: str, asked: str = "questions") -> str:
    """Common tables up to `sparse`, the best 15 of each query, filled up with documents of score 0."""
    return f"""
    words AS (SELECT {key} AS id, unnest({_tok("text")}) AS term FROM {docs}),
    tf AS (SELECT id, term, count(*) AS tf FROM words GROUP BY ALL),
    lens AS (SELECT {key} AS id, coalesce(len({_tok("text")}), 0) AS dl FROM {docs}),
    dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    raws AS (SELECT term, df, ln((SELECT count(*) FROM lens) - df + 0.5) - ln(df + 0.5) AS raw FROM dfs),
    terms AS (SELECT term, df, CASE WHEN raw >= 0 THEN raw ELSE 0.25 * (SELECT avg(raw) FROM raws) END AS idf FROM raws),
    said AS (SELECT query_id, unnest({_tok("query")}) AS term FROM {asked}),
    weights AS (SELECT query_id, a.term, count(*) * any_value(idf) AS w FROM said a JOIN terms USING (term) GROUP BY ALL),
    scores AS (
        SELECT query_id, id, sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM lens)))) AS score
        FROM weights JOIN tf USING (term) JOIN lens USING (id) GROUP BY ALL
    ),
    every AS (SELECT query_id, id, coalesce(score, 0) AS score, score IS NULL AS unseen FROM (SELECT DISTINCT query_id FROM {asked}) CROSS JOIN (SELECT DISTINCT id FROM lens) LEFT JOIN scores USING (query_id, id)),
    sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY unseen, round(score, 9) DESC, id) AS rank FROM every QUALIFY rank <= 15)
"""


def _places(name: str, rows: str, key: str, text: str) -> str:
    """Common tables of the stand-in embedding: each word adds or takes one at a place told by its MD5."""
    return f"""
    {name}_hashes AS (SELECT {key} AS id, md5(unnest({_tok(text)})) AS h FROM {rows}),
    {name}_places AS (SELECT id, ('0x' || h[1:4])::BIGINT % 64 AS place, sum(CASE WHEN h[5] >= '8' THEN 1 ELSE -1 END) AS v FROM {name}_hashes GROUP BY ALL),
    {name}_sizes AS (SELECT {key} AS id, coalesce(sum(v * v), 0) AS n FROM {rows} LEFT JOIN {name}_places p ON p.id = {key} GROUP BY ALL)
"""


_NEAR = f"""
    {_places("q", "questions", "query_id", "query")}, {_places("c", "library", "chunk_key", "text")},
    dots AS (SELECT q.id AS query_id, c.id, sum(q.v * c.v) AS dot FROM q_places q JOIN c_places c USING (place) GROUP BY ALL),
    near AS (SELECT q.id AS query_id, c.id, greatest((q.n > 0)::INT + (c.n > 0)::INT - CASE WHEN q.n > 0 AND c.n > 0 THEN 2 * coalesce(dot, 0) / sqrt(q.n * c.n) ELSE 0 END, 0) AS dd
        FROM q_sizes q CROSS JOIN c_sizes c LEFT JOIN dots d ON d.query_id = q.id AND d.id = c.id)
"""


def _fused(asked: str = "questions") -> str:
    return f"""{_LIBRARY}, {_bm25("library", "chunk_key", asked)}, {_NEAR},
    dense AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(dd, 9), id) AS rank FROM near QUALIFY rank <= 15),
    lists AS (SELECT query_id, id, rank, 'd' AS list FROM dense UNION ALL SELECT query_id, id, rank, 's' FROM sparse),
    sums AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS rrf, min(rank) FILTER (list = 'd') AS dr, min(rank) FILTER (list = 's') AS sr FROM lists GROUP BY ALL),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM sums QUALIFY rank <= 10)
"""


def _widened(m: int) -> str:
    """Common tables up to `wider`: questions with the first m synonyms of their longest term."""
    return f"""{_QUESTIONS},
    d AS (SELECT lower(term) AS term, min(expansions) AS expansions FROM query_expansions WHERE term IS NOT NULL AND term <> '' GROUP BY 1),
    m AS (SELECT query_id, d.term, expansions FROM questions JOIN d ON contains(lower(query), d.term) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(d.term) DESC, d.term) = 1),
    wider AS (SELECT q.query_id, CASE WHEN m.term IS NULL OR len(expansions) = 0 THEN query ELSE query || ' ' || array_to_string(expansions[1:{m}], ' ') END AS query FROM questions q LEFT JOIN m USING (query_id))
"""


_RERANKED = f"""{_widened(2)}, {_fused("wider")},
    scored AS (SELECT f.query_id, f.id, f.rank AS old, c.text, c.author, c.chapter, c.page, c.parent_content,
        round(1 / (1 + exp(-(6 * coalesce(len(list_intersect(list_distinct({_tok("q.query")}), list_distinct({_tok("c.text")}))) / nullif(len(list_distinct({_tok("q.query")})), 0), 0) - 3))), 6) AS similarity
        FROM fused f JOIN library c ON c.chunk_key = f.id JOIN questions q USING (query_id)),
    reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, old) AS rank FROM scored QUALIFY rank <= 5)
"""
_DIST = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))"
_DENSE = f"""
    near AS (SELECT a.vec_id AS query_id, a.label AS own, b.vec_id, b.label, {_DIST} AS dd FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
"""
_DENSE_OUT = "round(dd, 6) AS distance, round(least(greatest(1 - dd / 2, 0), 1), 6) AS similarity"
_SNIPPET = "CASE WHEN length({0}) <= {1} THEN {0} ELSE regexp_replace(substring({0}, 1, {1}), ' [^ ]*$', '') || '...' END"
_CHUNKS = "chunks AS (SELECT * FROM text_chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_key) = 1)"
_HITS = """
    one AS (SELECT * FROM retrieval_hits WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, hit_id) = 1),
    hits AS (SELECT query_id, chunk_id, source_file, page, similarity, row_number() OVER (PARTITION BY query_id ORDER BY rank, hit_id) AS rank FROM one)
"""
_CITE = """coalesce(nullif(concat_ws(', ', CASE WHEN author <> '' AND lower(author) <> 'unknown' THEN author END,
    CASE WHEN chapter <> 0 AND chapter <> -1 THEN 'Chapter ' || chapter END, CASE WHEN page <> 0 THEN 'page ' || page END), ''), 'Unknown source')"""
_USER = "users AS (SELECT conv_id, turn, content AS query FROM chat_messages WHERE lower(trim(role)) = 'user' AND content IS NOT NULL)"
_LANG = "CASE WHEN es > en * 1.5 THEN 'es' WHEN en > es * 1.5 THEN 'en' ELSE 'mixed' END"
_ES = " + ".join(f"contains(lower({{0}}), '{w}')::INT" for w in SPANISH)
_EN = " + ".join(f"contains(lower({{0}}), '{w}')::INT" for w in ENGLISH)
_KIND = " ".join(
    f"WHEN {' OR '.join(f"contains(head, '{w}')" for w in words)} THEN '{kind}'"
    for kind, words in (
        ("theorem", ("theorem", "teorema")), ("proof", ("proof", "demostración", "dem.", "prueba")), ("definition", ("definition", "definición")), ("example", ("example", "ejemplo")),
        ("lemma", ("lemma", "lema")), ("proposition", ("proposition", "proposición")), ("corollary", ("corollary", "corolario")), ("exercise", ("exercise", "ejercicio")),
    )
)
_LATEX = r"\$[^$]+\$|\\\[.*?\\\]|\\\(.*?\\\)"
_NAMED = "named AS (SELECT author FROM text_chunks WHERE author IS NOT NULL AND trim(author) <> '' AND lower(author) <> 'unknown')"
_QTEXT = "asked AS (SELECT query_id, i.text AS query FROM (SELECT DISTINCT query_id FROM retrieval_hits WHERE query_id IS NOT NULL) q JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS slot, count(*) OVER () AS n FROM benchmark_items) i ON i.slot = q.query_id % i.n)"


def _relevant(content: str) -> str:
    q = f"list_distinct({_tok('query')})"
    return f"(CASE WHEN coalesce(length({content}), 0) < 50 THEN false ELSE coalesce(len(list_intersect({q}, list_distinct({_tok(f'substring({content}, 1, 2000)')}))) / nullif(len({q}), 0) >= 0.2, true) END)"


_LAYOUT = r"""WITH pages AS (SELECT DISTINCT source_path, page FROM page_blocks),
            idx AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY source_path) AS n FROM pages),
            lim AS (SELECT *, n // 4 AS s, least(n, n // 4 + n // 2) AS e FROM idx),
            picked AS (SELECT source_path, page, count(*) OVER (PARTITION BY source_path) AS ns FROM (
                SELECT * FROM lim WHERE CASE WHEN e > s THEN i >= s AND i < e AND (i - s) % greatest(1, (e - s) // 10) = 0 AND (i - s) // greatest(1, (e - s) // 10) < 10 ELSE i < 10 END)),
            b AS (SELECT k.source_path, k.page, ns, page_height AS h, bbox[2] AS y0, bbox[4] AS y1,
                regexp_replace(array_to_string(list_transform(lines, lambda l: array_to_string(list_transform(l.spans, lambda x: x.text), ' ') || chr(10)), ''), '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS text
                FROM page_blocks k JOIN picked USING (source_path, page) WHERE lines IS NOT NULL),
            m AS (SELECT source_path, ns, h, CASE WHEN y1 < 0.15 * h THEN 'top' ELSE 'foot' END AS zone, CASE WHEN y1 < 0.15 * h THEN round(y1) ELSE round(y0) END AS y, text FROM b WHERE y1 < 0.15 * h OR y0 > (1 - 0.15) * h),
            ys AS (SELECT source_path, zone, y, max(h) AS h FROM m GROUP BY source_path, ns, zone, y HAVING count(*) >= 0.4 * ns),
            hs AS (SELECT source_path, max(y) FILTER (zone = 'top') + 5 AS hh, max(h) - min(y) FILTER (zone = 'foot') + 5 AS fh FROM ys GROUP BY source_path),
            ts AS (SELECT source_path, text FROM m WHERE text <> '' GROUP BY source_path, ns, zone, text HAVING count(*) >= 0.4 * ns),
            rs AS (SELECT source_path, array_to_string(list_sort(list_distinct(list(text))), '|') AS recurring FROM ts GROUP BY source_path)"""


def _around(pages: int) -> str:
    """Rows of `hits` and the `chunks` of so many pages around them."""
    return f"""files AS (SELECT query_id, source_file, min(rank) AS file_order FROM hits WHERE source_file <> '' AND page > 0 GROUP BY ALL),
            around AS (SELECT DISTINCT query_id, source_file, unnest(range(greatest(1, page - {pages}), page + {pages + 1})) AS page FROM hits WHERE source_file <> '' AND page > 0),
            cand AS (SELECT a.query_id, c.chunk_id, file_order, a.source_file, a.page FROM around a JOIN files USING (query_id, source_file) JOIN chunks c ON c.source_file = a.source_file AND c.page = a.page),
            fresh AS (SELECT * FROM cand WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = cand.query_id AND h.chunk_id = cand.chunk_id)),
            counts AS (SELECT query_id, count(*) AS n, greatest(0.3, min(similarity) - 0.05) AS least FROM hits GROUP BY query_id),
            added AS (SELECT f.*, n, least, row_number() OVER (PARTITION BY query_id ORDER BY file_order, source_file, page, chunk_id) AS pos FROM fresh f JOIN counts USING (query_id) QUALIFY pos <= 25 - n)
            SELECT query_id, chunk_id, similarity, true AS initial FROM hits
            UNION ALL SELECT query_id, chunk_id, coalesce(least, 0.3), false FROM added"""


def oracle_sql() -> dict[str, str]:
    known = lambda c: f"coalesce(nullif(trim({c}), ''), 'unknown')"
    return {
        "bm25_term_stats": f"WITH {_QUESTIONS}, {_bm25('documents', 'doc_id')} SELECT term, df, round(idf, 6) AS idf FROM terms",
        "bm25_multi_query_topk": f"WITH {_QUESTIONS}, {_bm25('documents', 'doc_id')} SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM sparse",
        "stored_index_topk": f"""WITH {_QUESTIONS}, marked AS (SELECT *, indexed_at < '2025-01-01' AS early FROM text_chunks WHERE chunk_id IS NOT NULL),
            first AS (SELECT * FROM marked WHERE early OR chunk_id NOT IN (SELECT chunk_id FROM marked WHERE early) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_index NULLS FIRST, text NULLS FIRST) = 1),
            {_bm25('first', 'chunk_id')} SELECT query_id, id AS chunk_id, round(score, 6) AS score, rank FROM sparse""",
        "dense_topk": f"WITH {_DENSE} SELECT query_id, vec_id, {_DENSE_OUT}, row_number() OVER (PARTITION BY query_id ORDER BY round(dd, 9), vec_id) AS rank FROM near QUALIFY rank <= 15",
        "dense_topk_filtered": f"WITH {_DENSE} SELECT query_id, vec_id, {_DENSE_OUT}, row_number() OVER (PARTITION BY query_id ORDER BY round(dd, 9), vec_id) AS rank FROM near WHERE own = label QUALIFY rank <= 5",
        "dense_topk_per_label": f"WITH {_DENSE} SELECT query_id, vec_id, {_DENSE_OUT}, row_number() OVER (PARTITION BY query_id, label ORDER BY round(dd, 9), vec_id) AS rank, label::VARCHAR AS label FROM near QUALIFY rank <= 3",
        "dense_topk_where": f"""WITH {_QUESTIONS}, {_LIBRARY}, {_NEAR}
            SELECT query_id, id AS chunk_id, round(least(greatest(1 - dd / 2, 0), 1), 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(dd, 9), id) AS rank
            FROM near JOIN library c ON c.chunk_key = near.id WHERE c.source_type = 'book' QUALIFY rank <= 5""",
        "rrf_fusion": f"WITH {_QUESTIONS}, {_fused()} SELECT query_id, id AS chunk_id, round(rrf, 9) AS rrf_score, rank FROM fused",
        "rrf_fusion_expanded": f"WITH {_widened(2)}, {_fused('wider')} SELECT query_id, id AS chunk_id, round(rrf, 9) AS rrf_score, rank FROM fused",
        "hybrid_reranked": f"WITH {_RERANKED} SELECT query_id, id AS chunk_id, similarity, rank, {_SNIPPET.format('text', 200)} AS snippet FROM reranked",
        "retrieved_context": f"""WITH {_RERANKED},
            parts AS (SELECT query_id, rank, '[Source ' || rank || ' - ' || {_CITE} || E']\\n' || coalesce(nullif(parent_content, ''), text) AS s FROM reranked),
            done AS (SELECT query_id, string_agg(s, E'\\n\\n---\\n\\n' ORDER BY rank) AS context FROM parts GROUP BY query_id)
            SELECT query_id, md5(context) AS digest, length(context) AS n_chars FROM done""",
        "deep_search_by_author": f"""WITH {_widened(3)}, {_LIBRARY}, {_NAMED},
            asked AS (SELECT query_id * 2 AS query_id, query FROM questions UNION ALL SELECT query_id * 2 + 1, query FROM wider),
            {_NEAR.replace("questions", "asked")},
            authors AS (SELECT author, row_number() OVER (ORDER BY CASE WHEN contains(lower(author), 'kelmora') OR contains(lower(author), 'duvarin') THEN 0 ELSE 1 END, author) AS position FROM (SELECT DISTINCT author FROM named)),
            best AS (SELECT n.query_id // 2 AS query_id, n.query_id % 2 AS list, id, c.author, c.text, c.parent_content, round(least(greatest(1 - dd / 2, 0), 1), 6) AS similarity
                FROM near n JOIN library c ON c.chunk_key = n.id WHERE trim(c.author) <> '' QUALIFY row_number() OVER (PARTITION BY n.query_id, c.author ORDER BY round(dd, 9), id) <= 3),
            top AS (SELECT b.*, a.position, coalesce(nullif(parent_content, ''), text) AS body, q.query FROM (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY list) = 1) b
                JOIN authors a USING (author) JOIN questions q USING (query_id)),
            won AS (SELECT query_id, min(position) AS position FROM top WHERE {_relevant("body")} GROUP BY query_id)
            SELECT query_id, id AS chunk_id, author, greatest(similarity, 0.9) AS similarity FROM top JOIN won USING (query_id, position)""",
        "query_expansion": f"""WITH {_USER},
            d AS (SELECT lower(term) AS term, min(expansions) AS expansions FROM query_expansions WHERE term IS NOT NULL AND term <> '' GROUP BY 1),
            m AS (SELECT conv_id, turn, d.term, expansions FROM users JOIN d ON contains(lower(query), d.term) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(d.term) DESC, d.term) = 1)
            SELECT u.conv_id, u.turn, m.term, CASE WHEN m.term IS NULL OR len(expansions) = 0 THEN query ELSE query || ' ' || array_to_string(expansions[1:3], ' ') END AS expanded
            FROM users u LEFT JOIN m USING (conv_id, turn)""",
        "expansion_info": f"WITH {_USER} SELECT conv_id, turn, lower(term) AS term, instr(lower(query), lower(term)) - 1 AS position, len(expansions) AS n_expansions FROM users JOIN query_expansions ON contains(lower(query), lower(term)) WHERE term <> ''",
        "neighbour_expansion": f"WITH {_CHUNKS}, {_HITS}, {_around(1)}",
        "expanded_retrieval": f"""WITH {_RERANKED}, chunks AS (SELECT chunk_key AS chunk_id, source_file, page FROM library),
            hits AS (SELECT query_id, id AS chunk_id, c.source_file, c.page, similarity, rank FROM reranked JOIN chunks c ON c.chunk_id = id), {_around(2)}""",
        "answer_prompts": f"""WITH {_CHUNKS}, {_HITS}, {_QTEXT},
            judged AS (SELECT h.query_id, h.chunk_id, h.rank AS old, c.author, c.chapter, h.page, coalesce(nullif(parent_content, ''), text) AS body, {_relevant("c.text")} AS ok FROM hits h JOIN chunks c USING (chunk_id) JOIN asked USING (query_id)),
            any_ok AS (SELECT query_id FROM judged WHERE old <= 5 AND ok GROUP BY query_id),
            kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY old) AS rank FROM judged JOIN any_ok USING (query_id) WHERE old > 5 OR ok),
            context AS (SELECT query_id, string_agg('[Source ' || rank || ' - ' || {_CITE} || E']\\n' || body, E'\\n\\n---\\n\\n' ORDER BY rank) AS context FROM kept GROUP BY query_id),
            found AS (SELECT a.query_id, query, context, {_ES.format('query')} AS es, {_EN.format('query')} AS en FROM asked a LEFT JOIN context USING (query_id)),
            told AS (SELECT *, CASE WHEN length(query) < 20 THEN 'en' WHEN ({_LANG}) = 'es' THEN 'es' ELSE 'en' END AS language FROM found),
            p AS (SELECT query_id, language, E'\\n' || CASE WHEN trim(coalesce(context, '')) = '' THEN E'\\n=== NO RELEVANT CONTEXT FOUND ===\\n' ELSE E'\\n=== CONTEXT FROM BIBLIOGRAPHY ===\\n\\n' || context || E'\\n\\n=== END OF CONTEXT ===\\n' END
                || E'\\n\\n\\n\\nQUESTION: ' || query || E'\\n\\nANSWER (with citations):\\n\\nCRITICAL: The user asked in ' || CASE language WHEN 'es' THEN 'Spanish. You MUST respond in SPANISH.' ELSE 'English. You MUST respond in ENGLISH.' END AS prompt FROM told)
            SELECT query_id, language, md5(prompt) AS digest, length(prompt) // 4 AS tokens FROM p""",
        "clean_text_recurring": _LAYOUT + r""",
            marks AS (SELECT source_path, list_distinct(list(text)) AS texts FROM ts GROUP BY source_path),
            less AS (SELECT page_id, CASE WHEN texts IS NULL THEN p.text ELSE list_reduce(list_prepend(p.text, list_sort(texts)), lambda a, x: replace(a, x, '')) END AS text FROM extracted_pages p LEFT JOIN marks USING (source_path))
            SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
                '([\pL\pM\pN\p{Pc}])-\n([\pL\pM\pN\p{Pc}])', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), '(?m)^[^\S\n]*[0-9]+[^\S\n]*$', '', 'g'),
                '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS text FROM less""",
        "context_flat": f"""WITH {_CHUNKS}, {_HITS},
            parts AS (SELECT h.query_id, h.rank, '[Source ' || h.rank || ' - ' || {_CITE.replace("page", "h.page")} || E']\\n' || coalesce(nullif(parent_content, ''), text) AS s FROM hits h JOIN chunks c USING (chunk_id)),
            done AS (SELECT query_id, string_agg(s, E'\\n\\n---\\n\\n' ORDER BY rank) AS context FROM parts GROUP BY query_id)
            SELECT query_id, md5(context) AS digest, length(context) AS n_chars FROM done""".replace("h.h.page", "h.page").replace("'h.page '", "'page '"),
        "context_grouped": f"""WITH {_CHUNKS}, {_HITS},
            ordered AS (SELECT h.query_id, h.source_file, h.page, c.author, c.chapter, coalesce(nullif(parent_content, ''), text, '') AS body,
                row_number() OVER w AS n, lag(h.source_file) OVER w AS before FROM hits h JOIN chunks c USING (chunk_id)
                WINDOW w AS (PARTITION BY h.query_id ORDER BY h.source_file NULLS FIRST, h.page NULLS FIRST, h.similarity DESC NULLS LAST, h.chunk_id)),
            parts AS (SELECT query_id, n, CASE WHEN n > 1 AND before IS NOT DISTINCT FROM source_file THEN '' ELSE E'\\n=== From: ' || coalesce(author, 'Unknown') || ' - ' || coalesce(source_file, 'Unknown') || E' ===\\n\\n' END
                || '[' || {_CITE} || E']\\n' || body || E'\\n' AS s FROM ordered),
            done AS (SELECT query_id, string_agg(s, E'\\n' ORDER BY n) AS context FROM parts GROUP BY query_id)
            SELECT query_id, md5(context) AS digest, length(context) AS n_chars FROM done""",
        "reading_order": f"""WITH {_HITS} SELECT query_id, chunk_id,
            row_number() OVER (PARTITION BY query_id ORDER BY source_file NULLS FIRST, page NULLS FIRST, similarity DESC NULLS LAST, chunk_id) AS read_pos,
            row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, source_file NULLS FIRST, page NULLS FIRST, chunk_id) AS shown_pos FROM hits""",
        "confidence_batch": """WITH best AS (SELECT query_id, similarity FROM retrieval_hits WHERE similarity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC) <= 3),
            agg AS (SELECT query_id, max(similarity) AS top, avg(similarity) AS mean FROM best GROUP BY query_id),
            all_q AS (SELECT DISTINCT query_id FROM retrieval_hits WHERE query_id IS NOT NULL),
            lv AS (SELECT query_id, top, mean, CASE WHEN top IS NULL OR top < 0.5 THEN 'insufficient' WHEN top > 0.75 AND mean > 0.65 THEN 'high' WHEN top > 0.6 THEN 'medium' ELSE 'low' END AS level FROM all_q LEFT JOIN agg USING (query_id))
            SELECT query_id, level, coalesce(top, 0) AS score, round(coalesce(mean, 0), 9) AS avg_similarity, level <> 'insufficient' AS should_respond FROM lv""",
        "relevance_top5_filter": f"""WITH {_CHUNKS}, {_HITS}, {_QTEXT},
            judged AS (SELECT h.query_id, h.chunk_id, h.rank, {_relevant("c.text")} AS ok FROM hits h JOIN chunks c USING (chunk_id) JOIN asked USING (query_id)),
            any_ok AS (SELECT query_id FROM judged WHERE rank <= 5 AND ok GROUP BY query_id)
            SELECT query_id, chunk_id, rank, rank <= 5 AS verified FROM judged JOIN any_ok USING (query_id) WHERE rank > 5 OR ok""",
        "deep_search_first_author": f"""WITH {_CHUNKS}, {_HITS}, {_QTEXT}, {_NAMED},
            authors AS (SELECT author, row_number() OVER (ORDER BY CASE WHEN contains(lower(author), 'kelmora') OR contains(lower(author), 'duvarin') THEN 0 ELSE 1 END, author) AS position FROM (SELECT DISTINCT author FROM named)),
            top AS (SELECT h.query_id, h.chunk_id, c.author, a.position, h.similarity, coalesce(nullif(c.parent_content, ''), c.text) AS body, q.query FROM hits h JOIN chunks c USING (chunk_id) JOIN asked q USING (query_id) JOIN authors a ON a.author = c.author
                QUALIFY row_number() OVER (PARTITION BY h.query_id, c.author ORDER BY h.similarity DESC NULLS LAST, h.rank, h.chunk_id) <= 3),
            won AS (SELECT query_id, min(position) AS position FROM top WHERE {_relevant("body")} GROUP BY query_id)
            SELECT query_id, chunk_id, author, greatest(coalesce(similarity, 0), 0.9) AS similarity FROM top JOIN won USING (query_id, position)""",
        "collection_stats": f"""
            SELECT 'source_type' AS dimension, {known("source_type")} AS value, count(*) AS n, count(DISTINCT source_file) AS n_files FROM text_chunks GROUP BY 2
            UNION ALL SELECT 'author', {known("author")}, count(*), count(DISTINCT source_file) FROM text_chunks GROUP BY 2
            UNION ALL SELECT 'language', {known("language")}, count(*), count(DISTINCT source_file) FROM text_chunks GROUP BY 2
            UNION ALL SELECT 'all', '', count(*), count(DISTINCT source_file) FROM text_chunks""",
        "distinct_values": "SELECT DISTINCT 'author' AS field, author AS value FROM text_chunks WHERE author <> '' UNION ALL SELECT DISTINCT 'source_file', source_file FROM text_chunks WHERE source_file <> ''",
        "count_by_type_zero_filled": """SELECT t.source_type, count(DISTINCT source_path) AS n_files FROM (VALUES ('book'), ('lecture_notes'), ('exercises')) t(source_type)
            LEFT JOIN extracted_pages p ON p.source_type = t.source_type GROUP BY 1""",
        "top_authors": f"WITH {_NAMED} SELECT author, count(*) AS n FROM named GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "priority_authors": f"WITH {_NAMED} SELECT author, row_number() OVER (ORDER BY CASE WHEN contains(lower(author), 'kelmora') OR contains(lower(author), 'duvarin') THEN 0 ELSE 1 END, author) AS position FROM (SELECT DISTINCT author FROM named)",
        "chunking_stats": """SELECT source_type, count(DISTINCT source_file) AS n_documents, count(DISTINCT (source_file, page)) FILTER (page IS NOT NULL) AS n_pages, count(*) AS n_chunks, round(avg(length(text)), 6) AS mean_chars
            FROM text_chunks WHERE NOT coalesce(is_parent, false) GROUP BY source_type""",
        "incremental_new_files": "SELECT DISTINCT source_path FROM extracted_pages p WHERE source_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM text_chunks c WHERE c.source_path = p.source_path)",
        "incremental_new_chunks": """SELECT DISTINCT chunk_id FROM text_chunks a WHERE chunk_id IS NOT NULL AND indexed_at >= '2025-01-01'
            AND NOT EXISTS (SELECT 1 FROM text_chunks b WHERE b.chunk_id = a.chunk_id AND b.indexed_at < '2025-01-01')""",
        "delete_by_file": """WITH kept AS (SELECT * FROM text_chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_index NULLS FIRST, text NULLS FIRST) = 1),
            gone AS (SELECT source_file FROM kept WHERE source_file IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
            SELECT source_type, count(*) FILTER (source_file IS DISTINCT FROM (SELECT source_file FROM gone)) AS remaining, count(*) FILTER (source_file = (SELECT source_file FROM gone)) AS deleted FROM kept GROUP BY 1""",
        "hit_fields": "SELECT chunk_key, coalesce(source_file, 'Unknown') AS source_file, coalesce(page, 0) AS page, coalesce(author, 'Unknown') AS author, coalesce(source_type, 'unknown') AS source_type, nullif(chapter, -1) AS chapter FROM text_chunks",
        "ingested_library": r"""SELECT 'different pages with chunks' AS rule, count(*) AS n FROM (SELECT DISTINCT source_path, page_number FROM extracted_pages WHERE regexp_matches(text, '[^\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]'))
            UNION ALL SELECT rule, 0 FROM (VALUES ('chunks over the limit'), ('documents whose index has gaps or repeats'), ('children without a parent'), ('children not counted by a parent'),
                ('parents over the limit with several children'), ('chunks not stored'), ('chunks added twice')) t(rule)""",
        "verified_confidence": f"""WITH {_CHUNKS}, {_HITS}, {_QTEXT},
            judged AS (SELECT h.query_id, h.rank, h.similarity, {_relevant("c.text")} AS ok FROM hits h JOIN chunks c USING (chunk_id) JOIN asked USING (query_id)),
            any_ok AS (SELECT query_id FROM judged WHERE rank <= 5 AND ok GROUP BY query_id),
            kept AS (SELECT * FROM judged JOIN any_ok USING (query_id) WHERE (rank > 5 OR ok) AND similarity IS NOT NULL),
            best AS (SELECT query_id, similarity FROM kept QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC) <= 3),
            agg AS (SELECT query_id, max(similarity) AS top, avg(similarity) AS mean FROM best GROUP BY query_id),
            lv AS (SELECT a.query_id, top, mean, a.query_id IN (SELECT query_id FROM judged) AND a.query_id NOT IN (SELECT query_id FROM any_ok) AS failed FROM (SELECT DISTINCT query_id FROM asked) a LEFT JOIN agg USING (query_id)),
            named AS (SELECT *, CASE WHEN failed THEN 'low' WHEN top IS NULL OR top < 0.5 THEN 'insufficient' WHEN top > 0.75 AND mean > 0.65 THEN 'high' WHEN top > 0.6 THEN 'medium' ELSE 'low' END AS level FROM lv)
            SELECT query_id, level, CASE WHEN failed THEN 0 ELSE coalesce(top, 0) END AS score, CASE WHEN failed THEN 0 ELSE round(coalesce(mean, 0), 9) END AS avg_similarity, failed OR level <> 'insufficient' AS should_respond,
                CASE WHEN level = 'low' THEN '⚠️ **Note:** The available bibliography has limited information on this specific topic. The response below may be incomplete. Please verify with your professor or additional resources.' END AS notice FROM named""",
        "exported_chunks": """SELECT chunk_key, coalesce(author, '') AS author, coalesce(nullif(chapter, 0), -1) AS chapter, coalesce(parent_id, '') AS parent_id, coalesce(array_to_string(child_ids, ','), '') AS child_ids, has_latex FROM text_chunks""",
        "citations": f"SELECT chunk_key, {_CITE} AS citation, concat_ws(', ', coalesce(nullif(author, ''), 'Unknown'), CASE WHEN chapter <> 0 AND chapter <> -1 THEN 'Chapter ' || chapter END, 'page ' || coalesce(page, 0)) AS ui_citation FROM text_chunks",
        "snippets": f"SELECT chunk_key, {_SNIPPET.format('text', 200)} AS snippet, length(text) // 4 AS tokens, len({_tok('text')}) AS words, length(coalesce(nullif(parent_content, ''), text)) AS context_chars FROM text_chunks",
        "similarity_scores": "SELECT hit_id, round(least(greatest(1 - distance / 2, 0.0), 1.0), 9) AS from_distance, round(1 / (1 + exp(-similarity)), 9) AS logistic FROM retrieval_hits",
        "source_types": """SELECT page_id, coalesce((map {'books': 'book', 'lecture_notes': 'lecture_notes', 'exercises': 'exercises'})[list_filter(list_transform(string_split(source_path, '/'), lambda x: lower(x)), lambda x: x IN ('books', 'lecture_notes', 'exercises'))[1]], 'book') AS source_type,
            regexp_replace(source_file, '\\.[^.]+$', '') AS stem FROM extracted_pages""",
        "author_infer": """WITH f AS (SELECT source_file, arg_min(text, (page_number, page_id)) AS text, lower(regexp_replace(source_file, '\\.[^.]+$', '')) AS low FROM extracted_pages WHERE source_file IS NOT NULL GROUP BY source_file)
            SELECT source_file, coalesce(
                CASE WHEN contains(low, 'kelmora') THEN 'Kelmora' WHEN contains(low, 'morvanic') THEN 'Morvanic' WHEN contains(low, 'duvarin') THEN 'Duvarin' WHEN contains(low, 'yaldure') THEN 'Yaldure' END,
                CASE WHEN contains(text, 'Kelmora') THEN 'Kelmora' WHEN contains(text, 'Morvanic') THEN 'Morvanic' WHEN contains(text, 'Duvarin') THEN 'Duvarin' WHEN contains(text, 'Yaldure') THEN 'Yaldure' END,
                upper(left(string_split(regexp_replace(low, '[_-]', ' ', 'g'), ' ')[1], 1)) || substring(string_split(regexp_replace(low, '[_-]', ' ', 'g'), ' ')[1], 2), '') AS author FROM f""",
        "language_heuristic": f"WITH c AS (SELECT page_id, {_ES.format('text')} AS es, {_EN.format('text')} AS en FROM extracted_pages) SELECT page_id, {_LANG} AS language FROM c",
        "chapter_carry": r"""WITH f AS (SELECT page_id, source_path, page_number, nullif(try_cast(nullif(regexp_extract(text, '(?im)^(?:Chapter|Capítulo)[\s]*(\d+)', 1), '') AS INT), 0) AS c FROM extracted_pages)
            SELECT page_id, last_value(c IGNORE NULLS) OVER (PARTITION BY source_path ORDER BY page_number NULLS FIRST, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter FROM f""",
        "latex_flag_and_tag": f"SELECT page_id, regexp_matches(text, '{_LATEX}', 's') AS has_latex, md5(regexp_replace(text, '{_LATEX}', '[LATEX]\\0[/LATEX]', 'gs')) AS tagged FROM extracted_pages",
        "latex_split_hints": f"""WITH t AS (SELECT page_id, regexp_replace(text, '{_LATEX}', '[LATEX]\\0[/LATEX]', 'gs') AS t FROM extracted_pages),
            a AS (SELECT page_id, replace(replace(replace(t, E'\\n[LATEX]', E'\\x01'), '[LATEX]', E'\\n\\n[LATEX]'), E'\\x01', E'\\n[LATEX]') AS t FROM t)
            SELECT page_id, md5(replace(replace(replace(t, E'[/LATEX]\\n', E'\\x01'), '[/LATEX]', E'[/LATEX]\\n\\n'), E'\\x01', E'[/LATEX]\\n')) AS digest FROM a""",
        "clean_text": r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
                '([\pL\pM\pN\p{Pc}])-\n([\pL\pM\pN\p{Pc}])', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), '(?m)^[^\S\n]*[0-9]+[^\S\n]*$', '', 'g'),
                '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS text FROM extracted_pages""",
        "block_types": rf"""WITH h AS (SELECT chunk_key, text, lower(substring(text, 1, 300)) AS head FROM text_chunks)
            SELECT chunk_key, CASE {_KIND} ELSE 'general' END AS block_type,
                regexp_matches(text, '(?i)(^|[^\pL\pM\pN_])(theorem|teorema)($|[^\pL\pM\pN_])') AS has_theorem,
                regexp_matches(text, '(?i)(^|[^\pL\pM\pN_])(proof|demostración|prueba)($|[^\pL\pM\pN_])') OR regexp_matches(text, '(?i)(^|[^\pL\pM\pN_])dem\.[\pL\pM\pN_]') AS has_proof,
                regexp_matches(text, '(?i)(^|[^\pL\pM\pN_])(definition|definición)($|[^\pL\pM\pN_])') AS has_definition FROM h""",
        "chunk_ids": """SELECT chunk_key, substring(replace(replace(replace(source_file, '.pdf', ''), ' ', '_'), '__', '_'), 1, 30) || '_p' || page || '_seq' || chunk_index || '_' || substring(md5(text), 1, 6) AS made_id FROM text_chunks""",
        "char_offsets": """WITH p AS (SELECT source_file, page_number, arg_min(text, page_id) AS page_text FROM extracted_pages WHERE source_file IS NOT NULL AND page_number IS NOT NULL GROUP BY ALL)
            SELECT chunk_key, greatest(coalesce(instr(page_text, substring(text, 1, 50)), 0) - 1, 0) AS start_char, greatest(coalesce(instr(page_text, substring(text, 1, 50)), 0) - 1, 0) + length(text) AS end_char
            FROM text_chunks c JOIN p ON c.source_file = p.source_file AND c.page = p.page_number WHERE NOT coalesce(is_parent, false)""",
        "source_records": f"SELECT chunk_key, author, page, chapter, source_type, {_SNIPPET.format('text', 200)} AS snippet FROM text_chunks",
        "badges": """WITH best AS (SELECT query_id, similarity FROM retrieval_hits WHERE similarity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC) <= 3),
            agg AS (SELECT query_id, max(similarity) AS top, avg(similarity) AS mean FROM best GROUP BY query_id),
            lv AS (SELECT query_id, CASE WHEN top IS NULL OR top < 0.5 THEN 3 WHEN top > 0.75 AND mean > 0.65 THEN 0 WHEN top > 0.6 THEN 1 ELSE 2 END AS n FROM (SELECT DISTINCT query_id FROM retrieval_hits WHERE query_id IS NOT NULL) LEFT JOIN agg USING (query_id))
            SELECT query_id, ['🟢', '🟡', '🔴', '⚫'][n + 1] AS emoji, ['#28a745', '#ffc107', '#dc3545', '#6c757d'][n + 1] AS colour FROM lv""",
        "rewrites": rf"""WITH {_USER},
            d AS (SELECT lower(term) AS term, min(expansions) AS expansions FROM query_expansions WHERE term IS NOT NULL AND term <> '' GROUP BY 1),
            m AS (SELECT conv_id, turn, d.term, expansions FROM users JOIN d ON contains(lower(query), d.term) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(d.term) DESC, d.term) = 1),
            e AS (SELECT u.conv_id, u.turn, query, CASE WHEN m.term IS NULL OR len(expansions) = 0 THEN query ELSE query || ' ' || array_to_string(expansions[1:3], ' ') END AS t FROM users u LEFT JOIN m USING (conv_id, turn)),
            a AS (SELECT conv_id, turn, query, trim(regexp_replace(t, '^\x27(.*)\x27$', '\1', 's')) AS t FROM e),
            r AS (SELECT conv_id, turn, query, CASE WHEN length(t) = 0 OR length(t) > greatest(300, 10 * length(query)) THEN query ELSE t END AS rewrite FROM a)
            SELECT conv_id, turn, rewrite, CASE WHEN rewrite <> query THEN query || chr(10) || chr(10) || '[Context: Search performed for ' || chr(39) || rewrite || chr(39) || ']' ELSE query END AS asked FROM r""",
        "scope_checks": f"WITH {_USER} SELECT conv_id, turn, EXISTS (SELECT 1 FROM query_expansions e WHERE e.term <> '' AND contains(lower(query), lower(e.term))) AS in_scope FROM users",
        "chat_window_prompt": """WITH r AS (SELECT conv_id, turn, upper(trim(role)) || ': ' || content AS s FROM chat_messages WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10),
            h AS (SELECT conv_id, string_agg(s, chr(10) ORDER BY turn) AS history FROM r GROUP BY conv_id),
            q AS (SELECT conv_id, arg_max(content, turn) AS question FROM chat_messages WHERE lower(trim(role)) = 'user' AND content IS NOT NULL GROUP BY conv_id),
            p AS (SELECT conv_id, E'\\n\\n=== NO RELEVANT CONTEXT FOUND ===\\n\\n\\n' || CASE WHEN history = '' THEN '' ELSE E'\\n=== PREVIOUS CONVERSATION ===\\n' || history || E'\\n=== END OF CONVERSATION ===\\n' END
                || E'\\n\\nQUESTION: ' || question || E'\\n\\nANSWER (with citations):\\n\\nCRITICAL: The user asked in English. You MUST respond in ENGLISH.' AS prompt FROM h JOIN q USING (conv_id))
            SELECT conv_id, prompt, length(prompt) // 4 AS tokens FROM p""",
        "highlights": r"""WITH c AS (SELECT chunk_key, trim(regexp_replace(regexp_replace(parent_content, 'CHAPTER \d+\.[^\n]*\n', chr(10), 'g'), '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS p,
                trim(regexp_replace(regexp_replace(text, 'CHAPTER \d+\.[^\n]*\n', chr(10), 'g'), '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS t FROM text_chunks),
            f AS (SELECT *, instr(lower(p), lower(t)) AS k, length(t) AS n FROM c)
            SELECT chunk_key, CASE WHEN coalesce(p, '') = '' THEN t WHEN t = '' OR k = 0 THEN trim(regexp_replace('... ' || t || ' ...', ' +', ' ', 'g'))
                ELSE trim(regexp_replace(CASE WHEN k > 201 THEN '...' ELSE '' END || substring(p, greatest(1, k - 200), k - greatest(1, k - 200)) || ' :orange[**' || substring(p, k, n) || '**] ' || substring(p, k + n, 200) || CASE WHEN length(p) >= k + n + 200 THEN '...' ELSE '' END, ' +', ' ', 'g')) END AS shown FROM f""",
        "rewrite_history": """WITH r AS (SELECT conv_id, turn, upper(trim(role)) || ': ' || CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS s FROM chat_messages WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)
            SELECT conv_id, string_agg(s, chr(10) ORDER BY turn) AS history FROM r GROUP BY conv_id""",
        "answer_language": f"WITH {_USER}, c AS (SELECT conv_id, turn, query, {_ES.format('query')} AS es, {_EN.format('query')} AS en FROM users) SELECT conv_id, turn, CASE WHEN length(query) < 20 THEN 'en' WHEN ({_LANG}) = 'es' THEN 'es' ELSE 'en' END AS language FROM c",
        "cache_keys": """WITH c AS (SELECT *, lag(content) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM chat_messages)
            SELECT conv_id, turn, md5(lower(trim(content)) || ':' || md5(substring(coalesce(before, ''), 1, 1000))) AS cache_key FROM c WHERE lower(trim(role)) = 'user' AND content IS NOT NULL""",
        "rate_limit_emit_times": """WITH t AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
            SELECT user_id, event_id, round(max(t - i) OVER (PARTITION BY user_id ORDER BY i) + i, 3) AS emit_at FROM t""",
        "cache_ttl_hits": """WITH RECURSIVE t AS (SELECT concat_ws('|', user_id, event_type) AS k, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL),
            s AS (SELECT k, event_id, i, t AS put, false AS hit FROM t WHERE i = 1
                UNION ALL SELECT t.k, t.event_id, t.i, CASE WHEN t.t - s.put <= 3600 THEN s.put ELSE t.t END, t.t - s.put <= 3600 FROM s JOIN t ON t.k = s.k AND t.i = s.i + 1)
            SELECT event_id, hit FROM s""",
        "session_quota": """WITH RECURSIVE t AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL),
            s AS (SELECT user_id, event_id, i, t AS began, 1 AS n, true AS allowed FROM t WHERE i = 1
                UNION ALL SELECT t.user_id, t.event_id, t.i, CASE WHEN t.t - began > 900 THEN t.t ELSE began END,
                    CASE WHEN t.t - began > 900 THEN 1 WHEN n >= 5 THEN n ELSE n + 1 END, t.t - began > 900 OR n < 5 FROM s JOIN t ON t.user_id = s.user_id AND t.i = s.i + 1)
            SELECT event_id, allowed FROM s""",
        "interval_merge": """WITH iv AS (SELECT source_file, page, start_char, end_char, CASE WHEN start_char <= max(end_char) OVER (PARTITION BY source_file, page ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
                FROM text_chunks WHERE NOT coalesce(is_parent, false) AND source_file IS NOT NULL AND page IS NOT NULL AND start_char IS NOT NULL AND end_char > start_char),
            g AS (SELECT *, sum(fresh) OVER (PARTITION BY source_file, page ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM iv)
            SELECT source_file, page, min(start_char) AS start, max(end_char) AS "end", count(*) AS n FROM g GROUP BY source_file, page, island""",
        "parent_packing": """WITH RECURSIVE c AS (SELECT source_path, page, chunk_key, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY source_path, page ORDER BY chunk_index NULLS FIRST, chunk_key) AS i
                FROM text_chunks WHERE NOT coalesce(is_parent, false) AND source_path IS NOT NULL AND page IS NOT NULL),
            s AS (SELECT source_path, page, chunk_key, i, n AS size, 0 AS seq FROM c WHERE i = 1
                UNION ALL SELECT c.source_path, c.page, c.chunk_key, c.i, CASE WHEN size > 0 AND size + c.n + 2 > 5000 OR size = 0 THEN c.n ELSE size + c.n + 2 END, CASE WHEN size > 0 AND size + c.n + 2 > 5000 THEN seq + 1 ELSE seq END
                FROM s JOIN c ON c.source_path = s.source_path AND c.page = s.page AND c.i = s.i + 1)
            SELECT chunk_key, seq AS parent_seq FROM s""",
        "layout_recurring_text": _LAYOUT + r"""
            SELECT d.source_path, round(coalesce(hh, 50), 3) AS header_height, round(coalesce(fh, 50), 3) AS footer_height, coalesce(recurring, '') AS recurring
            FROM (SELECT DISTINCT source_path FROM page_blocks) d LEFT JOIN hs USING (source_path) LEFT JOIN rs USING (source_path)""",
        "layout_pages": _LAYOUT + r""",
            marks AS (SELECT d.source_path, coalesce(hh, 50) AS hh, coalesce(fh, 50) AS fh, coalesce(texts, []) AS texts FROM (SELECT DISTINCT source_path FROM page_blocks) d LEFT JOIN hs USING (source_path)
                LEFT JOIN (SELECT source_path, list_distinct(list(text)) AS texts FROM ts GROUP BY source_path) USING (source_path)),
            raws AS (SELECT block_id, source_path, page, bbox, page_height, array_to_string(list_transform(lines, lambda l: array_to_string(list_transform(l.spans, lambda x: x.text), ' ') || chr(10)), '') AS raw FROM page_blocks WHERE lines IS NOT NULL),
            kept AS (SELECT k.*, regexp_replace(raw, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS text, hh, fh, texts FROM raws k JOIN marks USING (source_path))
            SELECT source_path, page, string_agg(raw, chr(10) ORDER BY block_id) AS text FROM kept
            WHERE text <> '' AND NOT list_contains(texts, text) AND NOT ((bbox[4] < hh OR bbox[2] > page_height - fh) AND regexp_full_match(replace(text, ' ', ''), '\p{Nd}+')) GROUP BY ALL""",
    }
