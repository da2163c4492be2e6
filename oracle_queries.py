"""The answer to every query in DuckDB SQL, written apart from the Spark code.

``ORACLE`` maps a query name to one statement over the given tables. Common table
expressions are put together from the named parts below. Queries that fit a model have no
statement.
"""

from __future__ import annotations

PARTS = {
    # articles seen in documents
    "art": r"""
        SELECT CAST(doc_id AS VARCHAR) AS id, regexp_extract(text, '^[^.\n]*') AS title,
               [source] AS authors, split_part(text, chr(10), 1) AS abstract,
               CAST(1990 + doc_id % 30 AS VARCHAR) AS release_date, lang AS article_type,
               CASE WHEN contains(text, chr(10)) THEN text END AS fulltext,
               CASE WHEN lang <> 'es' THEN 'https://example.org/' || CAST(doc_id AS VARCHAR) || '.pdf' END AS file_url,
               CASE WHEN n_chars >= 200 THEN [lang, source] END AS keywords,
               1528119650 + doc_id * 60 AS last_update
        FROM documents""",
    "copies": """
        SELECT * REPLACE (last_update + 3600 AS last_update, abstract || ' (edited)' AS abstract) FROM art""",
    # counted topic terms by source
    "tok": r"""
        SELECT CAST(doc_id AS VARCHAR) AS id, lpad(regexp_extract(source, '(\d+)', 1), 3, '0') AS topic,
               unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term
        FROM documents""",
    "cnt": "SELECT topic, term, count(*) AS n FROM tok GROUP BY topic, term",
    "tt": """
        SELECT topic, term, round(n / total, 6) AS weight,
               CAST(topic AS BIGINT) * 10 + place - 1 AS rank
        FROM (
            SELECT topic, term, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS place
            FROM cnt
            WHERE term IN (
                SELECT term FROM cnt GROUP BY term
                HAVING count(*) * 2 <= (SELECT count(DISTINCT topic) FROM cnt))
        )
        JOIN (SELECT topic, sum(n) AS total FROM cnt GROUP BY topic) USING (topic)
        WHERE place <= 10""",
    # topics of documents
    "hit": "SELECT tok.id, tt.topic, count(*) AS n FROM tok JOIN tt ON tok.term = tt.term GROUP BY ALL",
    "dt": "SELECT id AS docname, topic, round(n / sum(n) OVER (PARTITION BY id), 6) AS proportion FROM hit",
    "bag": """
        SELECT docname AS id, list(topic ORDER BY proportion DESC, topic) AS topics
        FROM dt WHERE proportion > 0.1 GROUP BY docname""",
    "idx": "SELECT art.*, bag.topics FROM art LEFT JOIN bag USING (id)",
    # requests
    "turns": "SELECT conv_id * 1000 + turn AS request_id, lower(text) AS request FROM conversations",
    "pairs": """
        SELECT CAST(topic AS BIGINT) AS request_id, string_agg(term, ' ' ORDER BY rank) AS request
        FROM tt WHERE rank % 10 < 2 GROUP BY topic""",
    "passages": "SELECT item_id AS request_id, text AS request FROM benchmark",
    "titles": "SELECT CAST(id AS BIGINT) AS request_id, title AS request FROM art",
    # words of requests, as {req}
    "word": r"""
        SELECT request_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word
        FROM (SELECT request_id, list_filter(regexp_split_to_array(request, '\s+'), lambda x: x <> '') AS w FROM {req})""",
    "stem_in": "SELECT DISTINCT word FROM word",
    # the published English stemming algorithm, one step per table
    "p0": r"""
        SELECT word, regexp_replace(regexp_replace(word, '^''', ''), '(^|[aeiouy])y', '\1Y', 'g') AS w FROM stem_in""",
    "p1": r"""
        SELECT word, w, CASE
            WHEN regexp_matches(w, '^(gener|arsen)') THEN 5 WHEN w LIKE 'commun%' THEN 6
            WHEN regexp_matches(w, '[aeiouy][^aeiouy]') THEN length(regexp_extract(w, '^.*?[aeiouy][^aeiouy]'))
            ELSE length(w) END AS r1 FROM p0""",
    "p2": r"""
        SELECT word, regexp_replace(w, '(''s''|''s|'')$', '') AS w, r1, CASE
            WHEN regexp_matches(substr(w, r1 + 1), '[aeiouy][^aeiouy]')
            THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^.*?[aeiouy][^aeiouy]'))
            ELSE length(w) END AS r2 FROM p1""",
    "p3": r"""
        SELECT word, r1, r2, CASE
            WHEN w LIKE '%sses' THEN w[:-3]
            WHEN w LIKE '%ied' OR w LIKE '%ies' THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w[:-2] END
            WHEN w LIKE '%us' OR w LIKE '%ss' THEN w
            WHEN regexp_matches(w, '[aeiouy].+s$') THEN w[:-2] ELSE w END AS w FROM p2""",
    "p4": r"""
        SELECT word, r1, r2, w,
            w IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed') AS done,
            CASE WHEN w LIKE '%eed' OR w LIKE '%eedly' THEN NULL
                 WHEN regexp_matches(w, '[aeiouy].*(ed|edly|ing|ingly)$')
                 THEN regexp_replace(w, '(ingly|edly|ing|ed)$', '') END AS cut
        FROM p3""",
    "p5": r"""
        SELECT word, r1, r2, done, w AS settled, CASE
            WHEN w LIKE '%eedly' THEN CASE WHEN length(w) - 5 >= r1 THEN w[:-4] ELSE w END
            WHEN w LIKE '%eed' THEN CASE WHEN length(w) - 3 >= r1 THEN w[:-2] ELSE w END
            WHEN cut IS NULL THEN w
            WHEN regexp_matches(cut, '(at|bl|iz)$') THEN cut || 'e'
            WHEN regexp_matches(cut, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN cut[:-2]
            WHEN length(cut) <= r1 AND regexp_matches(cut, '(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$') THEN cut || 'e'
            ELSE cut END AS w
        FROM p4""",
    "p6": r"SELECT * REPLACE (regexp_replace(w, '(.[^aeiouy])[yY]$', '\1i') AS w) FROM p5",
    "p7": r"""
        SELECT *, regexp_extract(w, '(ization|ational|fulness|ousness|iveness|tional|biliti|lessli|entli|ation|alism|aliti|ousli|iviti|fulli|enci|anci|abli|izer|ator|alli|bli|ogi|li)$') AS e2
        FROM p6""",
    "p8": r"""
        SELECT word, r1, r2, done, settled, CASE
            WHEN e2 = '' OR length(w) - length(e2) < r1 THEN w
            WHEN e2 = 'li' THEN CASE WHEN regexp_matches(w, '[cdeghkmnrt]li$') THEN w[:-3] ELSE w END
            WHEN e2 = 'ogi' THEN CASE WHEN w LIKE '%logi' THEN w[:-2] ELSE w END
            ELSE left(w, length(w) - length(e2)) || CASE e2
                WHEN 'tional' THEN 'tion' WHEN 'enci' THEN 'ence' WHEN 'anci' THEN 'ance' WHEN 'abli' THEN 'able'
                WHEN 'entli' THEN 'ent' WHEN 'izer' THEN 'ize' WHEN 'ization' THEN 'ize'
                WHEN 'alism' THEN 'al' WHEN 'aliti' THEN 'al' WHEN 'alli' THEN 'al'
                WHEN 'fulness' THEN 'ful' WHEN 'fulli' THEN 'ful' WHEN 'ousli' THEN 'ous' WHEN 'ousness' THEN 'ous'
                WHEN 'iveness' THEN 'ive' WHEN 'iviti' THEN 'ive' WHEN 'biliti' THEN 'ble' WHEN 'bli' THEN 'ble'
                WHEN 'lessli' THEN 'less' ELSE 'ate' END
            END AS w
        FROM p7""",
    "p9": r"SELECT *, regexp_extract(w, '(ational|tional|alize|icate|iciti|ative|ical|ness|ful)$') AS e3 FROM p8",
    "p10": r"""
        SELECT word, r1, r2, done, settled, CASE
            WHEN e3 = '' OR length(w) - length(e3) < r1 THEN w
            WHEN e3 = 'ative' AND length(w) - 5 < r2 THEN w
            ELSE left(w, length(w) - length(e3)) || CASE e3
                WHEN 'tional' THEN 'tion' WHEN 'ational' THEN 'ate' WHEN 'alize' THEN 'al'
                WHEN 'icate' THEN 'ic' WHEN 'iciti' THEN 'ic' WHEN 'ical' THEN 'ic' ELSE '' END
            END AS w
        FROM p9""",
    "p11": r"""
        SELECT *, regexp_extract(w, '(ement|ance|ence|able|ible|ment|ant|ent|ism|ate|iti|ous|ive|ize|ion|al|er|ic)$') AS e4 FROM p10""",
    "p12": r"""
        SELECT word, r1, r2, done, settled, CASE
            WHEN e4 = '' OR length(w) - length(e4) < r2 THEN w
            WHEN e4 = 'ion' AND NOT regexp_matches(w, '[st]ion$') THEN w
            ELSE left(w, length(w) - length(e4)) END AS w
        FROM p11""",
    "p13": r"""
        SELECT word, done, settled, CASE
            WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1
                 AND NOT regexp_matches(w[:-2], '(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$'))) THEN w[:-2]
            WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN w[:-2]
            ELSE w END AS w
        FROM p12""",
    "stems": """
        SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE
            CASE word WHEN 'skis' THEN 'ski' WHEN 'skies' THEN 'sky' WHEN 'dying' THEN 'die' WHEN 'lying' THEN 'lie'
                WHEN 'tying' THEN 'tie' WHEN 'idly' THEN 'idl' WHEN 'gently' THEN 'gentl' WHEN 'ugly' THEN 'ugli'
                WHEN 'early' THEN 'earli' WHEN 'only' THEN 'onli' WHEN 'singly' THEN 'singl' WHEN 'sky' THEN 'sky'
                WHEN 'news' THEN 'news' WHEN 'howe' THEN 'howe' WHEN 'atlas' THEN 'atlas' WHEN 'cosmos' THEN 'cosmos'
                WHEN 'bias' THEN 'bias' WHEN 'andes' THEN 'andes'
                ELSE replace(CASE WHEN done THEN settled ELSE w END, 'Y', 'y') END END AS stem
        FROM p13""",
    "form": """
        SELECT request_id, pos, word, 0 AS form, word AS term FROM word
        UNION ALL SELECT request_id, pos, word, 1, stem FROM word JOIN stems USING (word)""",
    "match": "SELECT form.*, tt.topic, tt.weight, tt.rank FROM form JOIN tt USING (term)",
    "clause": """
        SELECT r.request_id, r.request, coalesce(w.words, []) AS words, coalesce(m.topics, []) AS topics
        FROM {req} r
        LEFT JOIN (SELECT request_id, list(word ORDER BY pos) AS words FROM word GROUP BY request_id) w USING (request_id)
        LEFT JOIN (SELECT request_id, list(topic ORDER BY pos, form, rank) AS topics FROM match GROUP BY request_id) m USING (request_id)""",
    "top": """
        SELECT topic, term AS top_term FROM tt
        QUALIFY row_number() OVER (PARTITION BY topic ORDER BY weight DESC, rank, term) = 1""",
    # search, brute force
    "dw": r"""
        SELECT DISTINCT id, unnest(list_filter(regexp_split_to_array(
            lower(concat_ws(' ', title, abstract, fulltext)), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS word
        FROM art""",
    "df": "SELECT word, count(*) AS df FROM dw GROUP BY word",
    "qw": r"""
        SELECT request_id, w AS word, count(*) AS n FROM (
            SELECT request_id, unnest(list_filter(regexp_split_to_array(
                lower(array_to_string(words, ' ')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM clause)
        GROUP BY ALL""",
    "qi": """
        SELECT request_id, count(*) AS n_words,
               2 * sum(n * ln(1 + ((SELECT count(*) FROM art) - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))) AS word_score
        FROM qw LEFT JOIN df USING (word) GROUP BY request_id""",
    "allw": """
        SELECT request_id, id, any_value(word_score) AS word_score
        FROM qw JOIN dw USING (word) JOIN qi USING (request_id)
        GROUP BY request_id, id HAVING count(*) = any_value(n_words)""",
    "qt": "SELECT request_id, unnest(topics) AS topic FROM clause",
    "bt": "SELECT id, unnest(topics) AS topic FROM bag",
    "tsc": "SELECT request_id, id, 1.5 * count(*) AS topic_score FROM qt JOIN bt USING (topic) GROUP BY ALL",
    "sc": """
        SELECT request_id, id, round(coalesce(topic_score, 0) + coalesce(word_score, 0), 6) AS score
        FROM tsc FULL JOIN allw USING (request_id, id)""",
    "hits": """
        SELECT request_id, "order", id, title, abstract, article_type,
               CASE WHEN topics IS NULL THEN '' ELSE '["' || array_to_string(topics, '","') || '"]' END AS topics, score
        FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS "order" FROM sc)
        JOIN idx USING (id) WHERE "order" <= 30""",
}

STEMS = ["stem_in", *[f"p{i}" for i in range(14)], "stems"]
TERMS = ["tok", "cnt", "tt"]
DOC_TOPICS = [*TERMS, "hit", "dt"]
BAGS = [*DOC_TOPICS, "bag"]
INDEX = ["art", *BAGS, "idx"]
FORMS = ["word", *STEMS, "form"]
MATCH = [*TERMS, *FORMS, "match"]
SEARCH = [*INDEX, *FORMS, "match", "clause", "dw", "df", "qw", "qi", "allw", "qt", "bt", "tsc", "sc", "hits"]

# counted topic terms of the stored documents
STORED = {
    "ecnt": "SELECT topic, term, count(*) AS n FROM tok WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'en') GROUP BY ALL",
    "ett": PARTS["tt"].replace("cnt", "ecnt"),
}

WINDOW = "(SELECT min(last_update) + (max(last_update) - min(last_update)) // 120 * 60 FROM art) AND (SELECT max(last_update) FROM art)"


def sql(body: str, parts: list[str] = (), req: str | None = None, **extra: str) -> str:
    """``body`` over the named parts; requests come from the part ``req``."""
    names = list(parts)
    if req:
        need = {"pairs": TERMS, "titles": ["art"]}.get(req, [])
        names = [*need, *[n for n in names if n not in need]]
        at = max((names.index(n) for n in need), default=-1) + 1
        names.insert(at, req)
    defined = {**PARTS, **extra}
    ctes = ", ".join(f"{n} AS ({defined[n].replace('{req}', req or '')})" for n in names)
    return f"WITH {ctes} {body}" if ctes else body


def joined(name: str) -> str:
    return f"array_to_string({name}, '|') AS {name.split('.')[-1]}"


ARTICLE = f"""id, title, {joined('authors')}, abstract, release_date, article_type, fulltext, file_url,
    {joined('keywords')}, last_update"""
FIELDS = f"""title AS fields__title, array_to_string(authors, '|') AS fields__authors, abstract AS fields__abstract,
    release_date AS fields__release_date, article_type AS fields__article_type, file_url AS fields__file_url,
    array_to_string(keywords, '|') AS fields__keywords, fulltext AS fields__fulltext, last_update AS fields__last_update"""


def query_of(mode: str) -> str:
    tail = "'&q.parser=structured&return=title,abstract,article_type,topics&size=30'"
    if mode == "words":
        body = "'(and' || array_to_string(list_transform(words, lambda w: '(near+distance%3D3+''' || w || ''')'), '') || ')'"
    else:
        boosts = ("+boost%3D1.5", "+boost%3D2") if mode == "boosted" else ("", "")
        body = f"""'(or+' || array_to_string(list_transform(topics, lambda t: '(term+field%3Dtopics{boosts[0]}+''' || t || ''')'), '')
            || '(and' || array_to_string(list_transform(words, lambda w: '(near+distance%3D3{boosts[1]}+''' || w || ''')'), '') || '))'"""
    return f"CASE WHEN len(words) > 0 THEN '/2013-01-01/search?q=' || {body} || {tail} END AS query"


CLAUSES = [*MATCH, "clause"]
UNTAG = r"regexp_replace({0}, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', '', 'g')"


def decoded(value: str) -> str:
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), ("&amp", "&")):
        value = f"replace({value}, '{name}', '{char}')"
    return value


def plain(value: str) -> str:
    return decoded(UNTAG.format(value))


HREFS = r"""regexp_extract_all(html, '<li><a href="([^"]*)">', 1)"""
LABELS = r"""regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)"""
LABEL_TEXT = decoded(f"array_to_string({LABELS}, '|')")

ITEMS = r"""SELECT d.doc_id, CAST(l.doc_id AS VARCHAR) AS id, CASE WHEN len(regexp_extract(text, '^[^.\n]*')) BETWEEN 1 AND 60 THEN regexp_extract(text, '^[^.\n]*') END AS title
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

def _words(value: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({value}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


# the index after an update of the English articles and a removal
GONE = "CAST(id AS BIGINT) % 7 = 3"
SETTLED = {
    "art": f"""SELECT * REPLACE (abstract || CASE WHEN article_type = 'en' THEN ' (edited)' ELSE '' END AS abstract)
        FROM ({PARTS['art']}) WHERE NOT ({GONE})""",
    "bag": f"SELECT * FROM ({PARTS['bag']}) WHERE NOT ({GONE})",
    # places of words by field
    "spot": " UNION ALL ".join(f"SELECT id, {i} AS field, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT id, {_words(f)} AS w FROM art)"
                             for i, f in enumerate(("title", "abstract", "fulltext"))),
    # near clauses: two words of a passage; three and one
    "asked": r"""SELECT request_id, unnest(words) AS clause FROM (
        SELECT item_id * 2 + k AS request_id, CASE WHEN k = 0 THEN [array_to_string(w[1:2], ' ')] ELSE [array_to_string(w[1:3], ' '), w[4]] END AS words
        FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark), range(2) r(k))""",
    "unit": f"""SELECT request_id, u, count(*) AS n FROM (SELECT request_id, list_sort(list_distinct({_words('clause')})) AS u FROM asked)
        WHERE len(u) > 0 GROUP BY ALL""",
    "occurs": "SELECT u, id, field, pos, word FROM (SELECT DISTINCT u, unnest(u) AS word FROM unit) JOIN spot USING (word)",
    "holds": """SELECT DISTINCT u, id FROM (SELECT a.u, a.id, a.field, a.pos FROM occurs a JOIN occurs b
        ON a.u = b.u AND a.id = b.id AND a.field = b.field AND b.pos BETWEEN a.pos AND a.pos + len(a.u) - 1 + 3
        GROUP BY a.u, a.id, a.field, a.pos HAVING count(DISTINCT b.word) = len(a.u))""",
    "unit_score": """SELECT request_id, count(*) AS n_units, 2 * sum(n * ln(1 + ((SELECT count(*) FROM art) - coalesce(c, 0) + 0.5) / (coalesce(c, 0) + 0.5))) AS score
        FROM unit LEFT JOIN (SELECT u, count(*) AS c FROM holds GROUP BY u) USING (u) GROUP BY request_id""",
    "near_hit": """SELECT request_id, id, round(any_value(score), 6) AS score FROM unit JOIN holds USING (u) JOIN unit_score USING (request_id)
        GROUP BY request_id, id HAVING count(*) = any_value(n_units)""",
    # saturating weights of words by field
    "sizes": f"SELECT id, {', '.join(f'coalesce(len({_words(f)}), 0) AS {f}' for f in ('title', 'abstract', 'fulltext'))} FROM art",
    "tf": """SELECT word, id, sum(boost * c / (0.25 + 0.75 * size / mean)) AS tf FROM (
            SELECT word, id, field, count(*) AS c FROM spot GROUP BY ALL)
        JOIN (SELECT id, 0 AS field, 3.0 AS boost, title AS size, (SELECT avg(title) FROM sizes) AS mean FROM sizes
            UNION ALL SELECT id, 1, 1.5, abstract, (SELECT avg(abstract) FROM sizes) FROM sizes
            UNION ALL SELECT id, 2, 1.0, fulltext, (SELECT avg(fulltext) FROM sizes) FROM sizes) USING (id, field) GROUP BY word, id""",
    "freq": """SELECT request_id, id, round(any_value(coalesce(topic_score, 0)) + 2 * sum(n * ln(1 + ((SELECT count(*) FROM art) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)), 6) AS score
        FROM allw JOIN qw USING (request_id) JOIN df USING (word) JOIN tf USING (word, id) LEFT JOIN tsc USING (request_id, id) GROUP BY request_id, id""",
}
BEST = """SELECT request_id, id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS "order" FROM {0} QUALIFY "order" <= 30"""

ORACLE = {
    "s1_article_table": sql(f"""SELECT {ARTICLE},
        strftime(epoch_ms(last_update * 1000), '%Y-%m-%d') AS update_day FROM art""", ["art"]),
    "s2_topic_terms_csv": sql("SELECT topic, term, weight FROM tt", TERMS),
    "s3_doc_topics_csv": sql("SELECT * FROM dt", DOC_TOPICS),
    "s4_ris_articles": r"""SELECT source || CAST(doc_id AS VARCHAR) AS id,
        CASE WHEN lang <> 'en' THEN 'Translated ' || CAST(doc_id AS VARCHAR)
             ELSE nullif(trim(split_part(text, chr(10), 1)), '') END AS title,
        source || '|' || lang AS authors, trim(regexp_replace(text, '\s*\n\s*', ' ', 'g')) AS abstract,
        CAST(1990 + doc_id % 30 AS VARCHAR) AS release_date, lang AS article_type,
        lang || '|' || source AS keywords, 1530002937 AS last_update FROM documents""",
    "s5_pages": "SELECT page_id, url, html FROM pages",
    "s6_export_corpus": "SELECT CAST(doc_id AS VARCHAR) AS docname, text FROM documents",
    "s7_append_new": sql("""SELECT id, title, abstract, last_update FROM copies WHERE article_type = 'en'
        UNION ALL SELECT id, title, abstract, last_update FROM art WHERE article_type <> 'en'""", ["art", "copies"]),
    "s8_index_batches": sql(f"SELECT id, 'add' AS type, {FIELDS}, NULL::VARCHAR AS fields__topics FROM art", ["art"]),
    "s9_topic_bags_json": sql("SELECT id, array_to_string(topics, '|') AS fields__topics FROM bag", BAGS),
    "s10_docs_json": sql(f"SELECT {ARTICLE}, 'add' AS type, NULL::VARCHAR AS topics FROM art", ["art"]),
    "s11_hits_csv": sql('SELECT * EXCLUDE (score) FROM hits', SEARCH, "pairs"),
    "s12_query_log": sql(f"SELECT {query_of('boosted')} FROM clause", CLAUSES, "pairs"),
    "s13_response_hits": sql('SELECT * EXCLUDE (score) FROM hits', SEARCH, "pairs"),
    "s14_marks": """SELECT event_type || '-' || CAST(user_id AS VARCHAR) AS name,
        arg_max(CAST(floor(epoch(ts)) AS BIGINT), event_id) AS ts FROM events GROUP BY event_type, user_id""",
    "s15_feed": sql(f"SELECT {ARTICLE} FROM art", ["art"]),
    "s16_index_load": sql(f"""
        SELECT coalesce(c.id, i.id) AS id, coalesce(c.title, i.title) AS title,
               coalesce(c.abstract, i.abstract) AS abstract, coalesce(c.last_update, i.last_update) AS last_update,
               {joined('i.topics')}
        FROM (SELECT * FROM copies WHERE article_type = 'en') c
        FULL JOIN (SELECT * FROM idx WHERE topics IS NOT NULL) i ON c.id = i.id""", [*INDEX, "copies"]),
    "x1_identifiers": "SELECT page_id, replace(url, 'https://', '') AS id FROM pages",
    "x2_x9_article_fields": f"""SELECT
        {plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title,
        {LABEL_TEXT} AS authors,
        {plain("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")} AS abstract,
        {decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS release_date,
        regexp_extract(html, '<html lang=.([a-z]+)', 1) AS article_type,
        {plain("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} AS fulltext,
        {decoded(f"({HREFS})[1]")} AS file_url,
        {LABEL_TEXT} AS keywords, 1530002937 AS last_update FROM pages""",
    "x5_release_years": r"SELECT doc_id, CAST(nullif(regexp_extract(text, '(\d{4})', 1), '') AS BIGINT) AS year FROM documents",
    "x10_page_text": f"SELECT page_id, {plain('html')} AS text FROM pages",
    "x12_clean_identifiers": r"""SELECT conv_id, turn, regexp_replace(role || ' + ' || text, '[\s+]', '', 'g') AS id FROM conversations""",
    "x13_x15_item_links": f"""SELECT page_id, {decoded(f"({HREFS})[2]")} AS path,
        'https://example.org' || {decoded(f"({HREFS})[2]")} AS url_next FROM pages""",
    "x14_next_page": f"SELECT page_id, 'https://example.org' || {decoded(f'({HREFS})[1]')} AS url_next FROM pages",
    "x16_contents_rows": f"""SELECT page_id, {LABEL_TEXT} AS title, {decoded(f"array_to_string({HREFS}, '|')")} AS author,
        {decoded(f"({HREFS})[1]")} AS link FROM pages""",
    "x17_links_ending": f"""SELECT page_id, {decoded(f"array_to_string(list_filter({HREFS}, lambda h: h LIKE '%.'), '|')")} AS file_urls FROM pages""",
    "f1_valid_items": f"SELECT * FROM ({ITEMS}) WHERE id IS NOT NULL AND title IS NOT NULL",
    "f1_rejected_items": f"""SELECT *, CASE WHEN id IS NULL AND title IS NULL THEN 'id and title missing'
        WHEN id IS NULL THEN 'id missing' ELSE 'title missing' END AS reason
        FROM ({ITEMS}) WHERE id IS NULL OR title IS NULL""",
    "f2_increment": sql(f"SELECT id, title, last_update FROM art WHERE last_update BETWEEN {WINDOW}", ["art"]),
    "f3_strong_topics": sql("SELECT * FROM dt WHERE proportion > 0.1", DOC_TOPICS),
    "f4_above_threshold": sql("SELECT * FROM tt WHERE weight > (SELECT avg(weight) FROM tt)", TERMS),
    "a3_above_threshold_or_best": sql("""SELECT * FROM tt WHERE weight > (SELECT avg(weight) FROM tt) UNION ALL
        SELECT topic, term, weight, rank FROM (
            SELECT *, max(weight) OVER (PARTITION BY term) AS most,
                   row_number() OVER (PARTITION BY term ORDER BY weight DESC, rank) AS place FROM tt)
        WHERE most <= (SELECT avg(weight) FROM tt) AND place = 1""", TERMS),
    "f6_optional_fields": sql("""SELECT id, file_url IS NOT NULL AS has_file_url, keywords IS NOT NULL AS has_keywords,
        fulltext IS NOT NULL AS has_fulltext FROM art""", ["art"]),
    "p10_document_json": sql("""SELECT CAST(json_merge_patch('{}'::JSON, to_json({'id': id, 'type': 'add', 'fields': {
            'title': title, 'authors': authors, 'abstract': abstract, 'release_date': release_date,
            'article_type': article_type, 'file_url': file_url, 'keywords': keywords, 'fulltext': fulltext,
            'last_update': last_update}})) AS VARCHAR) AS json FROM art""", ["art"]),
    "p1_p2_typed_items": """SELECT CAST(doc_id AS VARCHAR) AS id, text AS title, source AS authors,
        NULL::VARCHAR AS abstract, CAST(n_chars AS VARCHAR) AS release_date, NULL::VARCHAR AS article_type,
        NULL::VARCHAR AS fulltext, NULL::VARCHAR AS file_url, NULL::VARCHAR AS keywords, doc_id AS last_update FROM documents""",
    "p4_p5_flat_documents": sql(f"""SELECT id, 'add' AS type, {FIELDS}, array_to_string(topics, '|') AS fields__topics
        FROM idx WHERE topics IS NOT NULL""", INDEX),
    "p6_unflattened_documents": sql(f"SELECT {ARTICLE}, 'add' AS type FROM art", ["art"]),
    "p8_hit_shape": sql("""SELECT id, CASE WHEN topics IS NULL THEN '' ELSE '["' || array_to_string(topics, '","') || '"]' END AS topics
        FROM idx""", INDEX),
    "p9_numbers": """SELECT l_orderkey, l_linenumber,
        CASE WHEN v % 1 > 0 THEN NULL ELSE CAST(trunc(v) AS BIGINT) END AS whole,
        CASE WHEN v % 1 > 0 THEN CAST(v AS DOUBLE) END AS fraction
        FROM (SELECT l_orderkey, l_linenumber, unnest([CAST(l_quantity AS DECIMAL(18,2)), CAST(l_extendedprice AS DECIMAL(18,2)),
            CAST(l_quantity - l_extendedprice AS DECIMAL(18,2))]) AS v FROM lineitem)""",
    "t1_words": sql("SELECT request_id, pos, word FROM word", ["word"], "turns"),
    "t2_stems": sql("SELECT word, stem FROM stems", ["tok", *STEMS], stem_in="SELECT DISTINCT term AS word FROM tok"),
    "t3_word_forms": sql("SELECT request_id, pos, word, form, term FROM form", FORMS, "turns"),
    "t4_topic_ids": r"""SELECT doc_id, lpad(regexp_extract(source, '(\d+)', 1), 3, '0') AS topic,
        CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0') ELSE CAST(doc_id AS VARCHAR) END AS padded FROM documents""",
    "t8_word_queries": sql(f"SELECT request_id, len(words) AS n_words, {query_of('words')} FROM clause", CLAUSES, "turns"),
    "t8_unboosted_queries": sql(f"SELECT request_id, len(words) AS n_words, {query_of('topics')} FROM clause", CLAUSES, "turns"),
    "t10_request_texts": sql("SELECT request_id, string_agg(word, ' ' ORDER BY pos) AS request FROM word GROUP BY request_id", ["word"], "turns"),
    "j1_enriched_articles": sql(f"SELECT {ARTICLE}, {joined('topics')} FROM idx WHERE topics IS NOT NULL", INDEX),
    "j1_enriched_left": sql(f"SELECT id, {joined('topics')} FROM idx", INDEX),
    "j2_term_lookup": sql("SELECT request_id, pos, form, word, term, topic, weight FROM match", MATCH, "turns"),
    "j3_top_term_join": sql("SELECT term, topic, top_term FROM tt JOIN top USING (topic)", [*TERMS, "top"]),
    "j4_insert_if_absent": sql(f"SELECT {ARTICLE} FROM art WHERE article_type <> 'en'", ["art"]),
    "j5_upsert": sql(f"""SELECT {ARTICLE}, {joined('topics')} FROM (
            SELECT * FROM idx WHERE topics IS NOT NULL AND article_type <> 'en'
            UNION ALL SELECT copies.*, bag.topics FROM copies LEFT JOIN bag USING (id) WHERE article_type = 'en')""",
        [*INDEX, "copies"]),
    "j7_postings": sql("""SELECT word, id FROM dw WHERE word IN (
            SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) FROM benchmark)""", ["art", "dw"]),
    "a1_topic_bags": sql(f"SELECT id, {joined('topics')} FROM bag", BAGS),
    "a2_best_topic_of_term": sql("""SELECT term, topic, weight, rank FROM tt
        QUALIFY row_number() OVER (PARTITION BY term ORDER BY weight DESC, rank) = 1""", TERMS),
    "a4_top_term_of_topic": sql("SELECT topic, top_term FROM top", [*TERMS, "top"]),
    "a5_keep_first": sql(f"SELECT {ARTICLE} FROM art", ["art"]),
    "a6_distinct_terms": sql("SELECT term, min(rank) AS first_rank FROM tt GROUP BY term", TERMS),
    "s8_exact_batches": """SELECT place // 4001 AS batch, count(*) AS n_documents
        FROM (SELECT row_number() OVER () - 1 AS place FROM documents) GROUP BY 1""",
    "p11_run_stamp": "SELECT event_id, epoch(ts) <= epoch(now()) AS past FROM events",
    "w2_a7_batch_counts": """SELECT place // 4001 AS batch, count(*) AS n_documents
        FROM (SELECT row_number() OVER () - 1 AS place FROM lineitem) GROUP BY 1""",
    "w2_batch_numbers": """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey,
        (row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) // 4001 AS batch FROM orders""",
    "w3_latest": """SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id, event_type, value, props FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY events.ts DESC, event_id DESC) = 1""",
    "o1_union": sql("""SELECT id, abstract, last_update FROM art UNION ALL
        SELECT id, abstract, last_update FROM copies""", ["art", "copies"]),
    "o2_topic_multiset": sql("SELECT request_id, topic, count(*) AS n FROM match GROUP BY ALL", MATCH, "turns"),
    "m1_vocabulary": r"""SELECT word, count(*) AS df FROM (
            SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS word
            FROM documents)
        GROUP BY word HAVING count(*) >= 2 AND count(*) <= 0.5 * (SELECT count(*) FROM documents)""",
    "m2_m3_topic_sizes": """SELECT printf('%03d', t) AS topic, '1' AS model_version, 10 AS n_terms, 10 AS n_distinct,
        10 * t AS first_rank, 10 * t + 9 AS last_rank FROM range(25) AS r(t)""",
    "m4_doc_topic_sums": r"""WITH said AS (
            SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS word
            FROM documents), kept AS (
            SELECT word FROM said GROUP BY word HAVING count(*) >= 2 AND count(*) <= 0.5 * (SELECT count(*) FROM documents))
        SELECT CAST(doc_id AS VARCHAR) AS docname, 25 AS n_topics, 1.0 AS total FROM said SEMI JOIN kept USING (word) GROUP BY doc_id""",
    "m2_sharded_word_mass": r"""WITH said AS (
            SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS word FROM documents)
        SELECT word, CAST(count(*) AS DOUBLE) AS n FROM said GROUP BY word
        HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) <= 0.5 * (SELECT count(*) FROM documents)""",
    "m4_sharded_doc_shares": r"""WITH said AS (
            SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS word FROM documents), kept AS (
            SELECT word FROM said GROUP BY word
            HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) <= 0.5 * (SELECT count(*) FROM documents))
        SELECT CAST(doc_id AS VARCHAR) AS docname, 25 AS n_topics, 1.0 AS total, count(*) AS n_words FROM said SEMI JOIN kept USING (word) GROUP BY doc_id""",
    "m1_word_lists": r"""SELECT docname, len(w) AS n_words, array_to_string(w, '|') AS words FROM (
        SELECT CAST(doc_id AS VARCHAR) AS docname,
               list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)""",
    "m5_extend_corpus": sql(f"""
        SELECT id AS docname, coalesce(fulltext || ' (edited)', abstract) AS text FROM art WHERE last_update BETWEEN {WINDOW}
        UNION ALL SELECT id, coalesce(fulltext, abstract) FROM art
        WHERE article_type = 'en' AND NOT last_update BETWEEN {WINDOW}""", ["art"]),
    "m5_topic_overlaps": sql("""SELECT o.topic, n.topic AS carried, round(sum(least(o.share, n.share)), 6) AS overlap
        FROM (SELECT topic, term, weight / sum(weight) OVER (PARTITION BY topic) AS share FROM ett WHERE weight > 0) o
        JOIN (SELECT topic, term, weight / sum(weight) OVER (PARTITION BY topic) AS share FROM tt WHERE weight > 0) n USING (term) GROUP BY ALL""",
        [*TERMS, "ecnt", "ett"], **STORED),
    "m6_counted_topic_terms": sql("SELECT topic, term, weight, rank FROM tt", TERMS),
    "g1_suggest": sql("""SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY pos, form, rank) AS pos,
        topic, top_term AS term, topic || ' : ' || top_term AS suggestion
        FROM match JOIN top USING (topic) WHERE weight > (SELECT avg(weight) FROM tt)""", [*MATCH, "top"], "turns"),
    "g1_suggest_fallback": sql("""SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY pos, form, rank) AS pos,
        topic, top_term AS term, topic || ' : ' || top_term AS suggestion
        FROM (SELECT *, max(weight) OVER (PARTITION BY request_id, pos, form) AS most,
                     row_number() OVER (PARTITION BY request_id, pos, form ORDER BY weight DESC, rank) AS place FROM match)
        JOIN top USING (topic) WHERE weight > 0.015 OR (most <= 0.015 AND place = 1)""", [*MATCH, "top"], "turns"),
    "a9_suggestion_lists": sql("""SELECT request_id, string_agg(topic || ' : ' || top_term, '|' ORDER BY pos, form, rank) AS suggestions
        FROM match JOIN top USING (topic) WHERE weight > (SELECT avg(weight) FROM tt) GROUP BY request_id""", [*MATCH, "top"], "turns"),
    "g2_expand_turns": sql(f"SELECT request_id, len(words) AS n_words, {query_of('boosted')} FROM clause", CLAUSES, "turns"),
    "g2_expand_terms": sql(f"SELECT request_id, request, len(words) AS n_words, {query_of('boosted')} FROM clause", CLAUSES, "pairs"),
    "a8_request_clauses": sql("SELECT request_id, array_to_string(words, '|') AS words, array_to_string(topics, '|') AS topics FROM clause", CLAUSES, "turns"),
    "q1_j6_topic_matches": sql("SELECT request_id, id, round(topic_score, 6) AS score FROM tsc", SEARCH, "pairs"),
    "q2_q3_word_matches": sql("SELECT request_id, id, round(word_score + coalesce(topic_score, 0), 6) AS score FROM allw LEFT JOIN tsc USING (request_id, id) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) <= 30", SEARCH, "titles"),
    "q4_q5_match_all": sql("SELECT * FROM sc", SEARCH, "pairs"),
    "q6_search_terms": sql("SELECT * FROM hits", SEARCH, "pairs"),
    "q6_search_passages": sql("SELECT * FROM hits", SEARCH, "passages"),
    "q6_search_titles": sql("SELECT * FROM hits", SEARCH, "titles"),
    "q6_kept_postings": sql("SELECT * FROM hits", SEARCH, "pairs", **SETTLED),
    "q2_near_matches": sql(BEST.format("near_hit"), ["art", "spot", "asked", "unit", "occurs", "holds", "unit_score", "near_hit"], **SETTLED),
    "q5_frequency_top": sql(BEST.format("freq"), [*SEARCH[:-1], "spot", "sizes", "tf", "freq"], "pairs", **SETTLED),
    "r1_first_seen_stream": sql(f"SELECT {ARTICLE} FROM art", ["art"]),
    "r1_sync_index_stream": sql(f"SELECT {ARTICLE.replace('abstract', 'copies.abstract')}, {joined('topics')} FROM copies LEFT JOIN bag USING (id)",
        [*INDEX, "copies"]),
}
