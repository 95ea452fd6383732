"""One query per operator of this subpackage, and their SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, context_tree, exact_dedup, language, lexical, line_dedup, minhash, packing, pii, prefix_counts, quality, vptree
from .common import id_remainder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Where the installed vocabularies are; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op4_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n
  FROM documents
), g AS (
  SELECT doc_id, n, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
    count(*) OVER (PARTITION BY n) AS group_size
  FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(n) AS text_sha256 FROM g
"""


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.fit(documents.where(id_remainder(5) != 0), vocabulary("piece_bpe_32k.model"))
    return language.identify(documents, model)


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_and_decode(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels").where(id_remainder(3) != 1))
    return quality.score(documents, model)


@query
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Likeness())


# Exact similarities of all pairs that share a shingle; components by their least id.
ORACLES["op1_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(shingle) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS one, b.doc_id AS other, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT one, other FROM pairs JOIN n x ON x.doc_id = one JOIN n y ON y.doc_id = other
  WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)
), either_way AS (
  SELECT one, other FROM links UNION ALL SELECT other, one FROM links
), reach AS (
  SELECT doc_id AS origin, doc_id AS reached FROM n
  UNION
  SELECT r.origin, b.other FROM reach r JOIN either_way b ON r.reached = b.one
)
SELECT n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT origin, min(reached) AS component_id FROM reach GROUP BY origin) c ON c.origin = n.doc_id
"""


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def _unlike_round(k: int) -> str:
    """From the holders of keys of round ``k``: those that are neither a key's first text nor a copy of it."""
    return f"""
firsts{k} AS (SELECT key, min(text_no) AS first FROM holders{k} GROUP BY key),
beside{k} AS (SELECT key, kind, text_no, first FROM holders{k} JOIN firsts{k} USING (key) WHERE text_no <> first),
pairs{k} AS (SELECT DISTINCT text_no, first FROM beside{k}),
elements{k} AS (
  SELECT text_no, first, pair, line, max(one) AS one, max(two) AS two FROM (
    SELECT p.text_no, p.first, e.pair, e.line, 1 AS one, 0 AS two FROM pairs{k} p JOIN neighbours e ON e.text_no = p.text_no
    UNION ALL SELECT p.text_no, p.first, e.pair, e.line, 0, 1 FROM pairs{k} p JOIN neighbours e ON e.text_no = p.first
  ) GROUP BY ALL
), rests{k} AS (
  SELECT text_no, first, sum(one) AS one, sum(two) AS two, sum(one * two) AS alike, count(*) AS n FROM (
    SELECT text_no, first, pair, max(one) AS one, max(two) AS two FROM elements{k} WHERE one + two < 2 GROUP BY ALL
  ) GROUP BY ALL
), copies{k} AS (
  SELECT e.text_no, e.first FROM (SELECT text_no, first, sum(one * two) AS shared, count(*) AS n FROM elements{k} GROUP BY ALL) e
  LEFT JOIN rests{k} r USING (text_no, first)
  WHERE r.n IS NULL OR r.alike * 100 >= r.n * 30 OR ((r.one = 0 OR r.two = 0) AND e.shared * 100 >= e.n * 60)
), holders{k + 1} AS (
  SELECT key, kind, text_no FROM beside{k} ANTI JOIN copies{k} USING (text_no, first)
)"""


# Texts are numbered from the largest; whole sets of neighbouring tokens stand for the lowest hashes.
ORACLES["op10_line_dedup"] = rf"""
WITH line_docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
texts AS (SELECT t, row_number() OVER (ORDER BY strlen(t) DESC, t) AS text_no FROM (SELECT DISTINCT t FROM line_docs)),
line_rows AS (
  SELECT text_no, u.n AS line_no, u.line AS raw, list_filter(regexp_split_to_array(u.line, '[\x20\x09\x0B-\x0D]+'), lambda x: x <> '') AS words
  FROM texts, unnest(list_transform(string_split(t, chr(10)), lambda x, i: {{'n': i - 1, 'line': x}})) AS x(u)
), line_words AS (
  SELECT text_no, line_no, words, len(words) AS n, array_to_string(words, ' ') AS line,
    list_transform(words, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tokens,
    row_number() OVER (PARTITION BY text_no ORDER BY line_no) AS place
  FROM line_rows WHERE len(words) > 0
), neighbours AS (
  SELECT DISTINCT text_no, line, unnest(list_transform(words, lambda x, i: x || ' ' || coalesce(words[i + 1], ''))) AS pair FROM line_words
), line_leaves AS (
  SELECT text_no, line_no, n, tokens[1:3] AS head, tokens FROM line_words WHERE n >= 3
), recurring_leaves AS (
  SELECT n, head FROM line_leaves GROUP BY ALL HAVING count(DISTINCT text_no) >= 4
), place_tokens AS (
  SELECT text_no, line_no, n, head, unnest(range(n)) AS spot, unnest(tokens) AS token
  FROM line_leaves JOIN recurring_leaves USING (n, head)
), constants AS (
  SELECT n, head, spot, token, 1 AS constant FROM place_tokens WHERE token <> '<*>' GROUP BY ALL HAVING count(DISTINCT text_no) >= 4
), templates AS (
  SELECT text_no, line_no, n || ' ' || array_to_string(head, ' ') || chr(10) ||
    string_agg(CASE WHEN constant = 1 OR token = '<*>' THEN token ELSE '' END, ' ' ORDER BY spot) AS key
  FROM place_tokens LEFT JOIN constants USING (n, head, spot, token)
  GROUP BY text_no, line_no, n, head HAVING count(constant) * 100 >= n * 80
), shared AS (
  SELECT text_no, line_no, place, line, n, sum(n) OVER (PARTITION BY text_no ORDER BY place) AS upto
  FROM line_words SEMI JOIN (SELECT line FROM line_words GROUP BY line HAVING count(DISTINCT text_no) >= 2) USING (line)
), runs AS (
  SELECT i.text_no, i.place, j.place >= i.place AS side, string_agg(j.line, chr(10) ORDER BY j.place) AS key, list(j.line_no) AS numbers
  FROM shared i JOIN shared j ON i.text_no = j.text_no AND j.place >= i.place AND j.upto - j.n - i.upto + i.n < 50
  GROUP BY ALL HAVING sum(j.n) >= 50 AND max(j.place) - min(j.place) + 1 = count(*)
  UNION ALL
  SELECT i.text_no, i.place, j.place > i.place AS side, string_agg(j.line, chr(10) ORDER BY j.place) AS key, list(j.line_no) AS numbers
  FROM shared i JOIN shared j ON i.text_no = j.text_no AND j.place <= i.place AND i.upto - j.upto < 50
  GROUP BY ALL HAVING sum(j.n) >= 50 AND max(j.place) - min(j.place) + 1 = count(*)
), found AS (
  SELECT 'line ' || key AS key, 4 AS kind, text_no, [line_no] AS numbers FROM templates
  UNION ALL SELECT 'run ' || key, 2, text_no, numbers FROM runs
), holders1 AS (
  SELECT DISTINCT key, kind, text_no FROM found
  SEMI JOIN (SELECT key FROM found GROUP BY key, kind HAVING count(DISTINCT text_no) >= kind) USING (key)
), {_unlike_round(1)}, {_unlike_round(2)}, {_unlike_round(3)}, recurring AS (
  SELECT key FROM holders2 WHERE kind = 2 UNION SELECT key FROM holders4 WHERE kind = 4
), dropped AS (
  SELECT DISTINCT text_no, unnest(numbers) AS line_no FROM found SEMI JOIN recurring USING (key)
), cleaned AS (
  SELECT l.text_no, count(*) AS n_lines, count(x.line_no) AS n_dropped,
    coalesce(string_agg(l.raw, chr(10) ORDER BY l.line_no) FILTER (WHERE x.line_no IS NULL), '') AS t
  FROM line_rows l LEFT JOIN dropped x USING (text_no, line_no) GROUP BY l.text_no
)
SELECT d.doc_id, c.n_lines::INTEGER AS n_lines, c.n_dropped::INTEGER AS n_dropped, length(c.t)::INTEGER AS n_chars, sha256(c.t) AS text_sha256
FROM line_docs d JOIN texts USING (t) JOIN cleaned c USING (text_no)
"""


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.find_personal_data(documents, pii.fit(documents))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


# Every phrase is counted and scored, whatever its bounds.
ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]+')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces
), f1 AS (
  SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(words) AS phrase FROM w) GROUP BY ALL
), f2 AS (
  SELECT lang, u, v, u || ' ' || v AS phrase, count(*) AS f FROM (
    SELECT lang, unnest(words[1:len(words) - 1]) AS u, unnest(words[2:]) AS v FROM w WHERE len(words) >= 2) GROUP BY ALL
), f3 AS (
  SELECT lang, u, v, x, u || ' ' || v || ' ' || x AS phrase, u || ' ' || v AS head, v || ' ' || x AS tail, count(*) AS f FROM (
    SELECT lang, unnest(words[1:len(words) - 2]) AS u, unnest(words[2:len(words) - 1]) AS v, unnest(words[3:]) AS x
    FROM w WHERE len(words) >= 3) GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT f2.lang, f2.phrase, f2.f AS a, 1 AS k, l.f AS l, r.f AS r FROM f2
    JOIN f1 l ON l.lang = f2.lang AND l.phrase = u JOIN f1 r ON r.lang = f2.lang AND r.phrase = v WHERE f2.f >= 10
  UNION ALL
  SELECT f3.lang, f3.phrase, f3.f, 1, l.f, r.f FROM f3
    JOIN f1 l ON l.lang = f3.lang AND l.phrase = f3.u JOIN f2 r ON r.lang = f3.lang AND r.phrase = tail
  UNION ALL
  SELECT f3.lang, f3.phrase, f3.f, 2, l.f, r.f FROM f3
    JOIN f2 l ON l.lang = f3.lang AND l.phrase = head JOIN f1 r ON r.lang = f3.lang AND r.phrase = x
), scored AS (
  SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, head AS phrase, f FROM f3 UNION ALL SELECT lang, tail, f FROM f3) GROUP BY ALL
), n AS (
  SELECT lang, sum(f) AS n FROM f1 GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
  n::BIGINT AS n, score::BIGINT AS score
FROM worst LEFT JOIN longer USING (lang, phrase) JOIN n USING (lang)
WHERE longer.f IS NULL OR 100 * longer.f < 50 * a
QUALIFY rank <= 2000
"""


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Every document that holds a term of an item is scored.
ORACLES["op12_lexical_search"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS row_no, doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS terms
  FROM documents
), d AS (
  SELECT row_no, doc_id, terms, len(terms)::BIGINT AS n FROM t WHERE len(terms) > 0
), whole AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d
), postings AS (
  SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM d) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, whole GROUP BY term, n_docs
), m AS (
  SELECT row_no, doc_id, 100 - 25 + ((25 * n * n_docs) // n_terms) AS m FROM d, whole
), items AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(list_filter(regexp_split_to_array(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL
), scored AS (
  SELECT item_id, doc_id, row_no, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN postings USING (term) JOIN m USING (row_no) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


@query
def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"), id_remainder(7) != 2)
